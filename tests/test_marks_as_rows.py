"""The marks of a domain reach the state as rows, not as a frame for each domain."""

from pyspark.sql import Row

from leadforge.streaming import marks


class Held:
    def __init__(self, value=None):
        self.value = value

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_the_latest_of_some_rows_replaces_the_mark_that_is_held():
    processor, big = marks.LatestMark(), 2**60 + 1
    processor.mark = Held(("A", True, None, "2024-05", 7))
    row = lambda tier, at, seq: Row(domain="a", human_tier=tier, pitch=None, note="n", reviewed_at=at, seq=seq)
    got = list(processor.handleInputRows(("a",), iter([row("B", "2024-04", 9), row("C", "2024-05", big), row("X", "2024-05", None)]), None))
    assert got == [row("C", "2024-05", big)] and processor.mark.value == ("C", None, "n", "2024-05", big)
    assert list(processor.handleInputRows(("a",), iter([row("C", "2024-05", big), row("D", None, None)]), None)) == []
