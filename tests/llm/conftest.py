"""A small table of awkward documents, shared by the operator tests."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: The table with columns whose names clash with what operators use inside.
EXTRA = ["id", "n", "size", "digest", "component", "key", "w", "s", "b", "before", "node", "block"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))


def awkward_rows():
    rng = random.Random(5)
    base = sentence(rng, 300)
    words = base.split()
    near = " ".join(["changed" if i in (10, 200) else w for i, w in enumerate(words)])
    far = " ".join(["changed" if i % 9 == 0 else w for i, w in enumerate(words)])
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, near, "en", "a", 1), (4, far, None, "b", 1), (5, None, "en", None, None),
        (6, "", "en", "a", 0), (7, " \t\n ", "en", "c", 3), (8, "one two three", "en", "c", 1), (9, "One  TWO\nthree", "en", "c", 1),
        (10, "x" * 50_000, "en", "d", 1), (11, sentence(rng, 20_000), "en", "a", 1), (12, "spam spam spam " * 60, "en", "a", 1),
        (13, "ÄÖ é 😀 ▁ <s> \x0b\x0c\r end ", "de", "b", 1), (13, "ÄÖ é 😀 ▁ <s> \x0b\x0c\r end ", "de", "b", 1), (None, "row without a key " + sentence(rng, 80), "en", "a", 1),
        (15, base.upper(), "en", "a", 1), (16, "line one\nline one\n\nline one\n" + sentence(rng, 70), "en", "e", 1),
    ]
    rows += [(100 + i, sentence(rng, rng.randint(40, 120)), "en", f"s{i % 4}", 1) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
