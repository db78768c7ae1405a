"""Rows that the dedup stages must not lose."""

import random

import pytest

from leadforge.llm import exact, ngrams

SCHEMA = "doc_id bigint, text string, source string, digest string"


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_one_row_of_each_digest_without_keys_stays(spark):
    rows = [(None, "alone", "a", "x"), (None, "two  rows", "a", "x"), (None, "two rows", "b", "x"), (None, "with key", "a", "x"), (3, "with key", "c", "x"), (4, "other", "a", "x")]
    got = [tuple(x) for x in exact.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(" ".join(x[1].split()) for x in got) == ["alone", "other", "two rows", "with key"]
    assert set(got) <= set(rows) and rows[4] in got
    again = exact.drop_copies(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, again)))


def test_a_text_that_repeats_a_dropped_id_stays(spark):
    base, other = text(1), text(2)
    near = base + " more"
    rows = [(1, base, "a", "x"), (2, near, "a", "x"), (2, other, "b", "x"), (None, text(3), "a", "x")]
    got = {x["text"] for x in ngrams.drop_similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {base, other, text(3)}


@pytest.mark.parametrize("key", [lambda i: i, lambda i: None if i is None else f"k{i:03d}"])
def test_repeated_rows_outlying_and_odd_keys(spark, key):
    rows = [(key(-(2**40)), "far", "a", "x"), *[(key(i), f"text {i % 7}", "a", "x") for i in range(20)], *[(key(3), "text 3", "a", "x")] * 3, (None, "text 4", "b", "x"), (None, "lone", "b", "x"), (None, "lone", "b", "x")]
    schema = SCHEMA if isinstance(key(1), int) else SCHEMA.replace("doc_id bigint", "doc_id string")
    df = spark.createDataFrame(rows, schema)
    got = exact.drop_copies(df).collect()
    assert sorted(x["text"] for x in got) == sorted({r[1] for r in rows})
    low = {r[1]: min((s[0] for s in rows if s[1] == r[1] and s[0] is not None), default=None) for r in rows}
    assert {x["text"]: x["doc_id"] for x in got} == low
    groups = exact.exact_groups(df).collect()
    assert len(groups) == len(rows) and sum(x["group_size"] == 1 for x in groups) == 1
