"""Runs of words that are too rare leave the phrase count before they become rows."""

import random

import numpy as np
import pytest

from leadforge.llm import phrases
from tests.llm.test_new_operators import SCHEMA, brute_phrases, rows_for_phrases


def test_rare_runs_of_frequent_pairs_are_not_passed_on(spark, monkeypatch):
    rng = random.Random(8)
    words = "a b c d e f g h".split()
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(12)] + ["in the long run. " * 9, "in the long run of it. in the long run of us"] * 6
    rows = [(i, t, "en", 1, 1, 1) for i, t in enumerate(texts)]
    made = []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    step = type(df).mapInPandas

    def counted(self, func, schema, *more):
        out = step(self, func, schema, *more)
        if "h3 bigint" in schema:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(df), "mapInPandas", counted)
    got = phrases.collocations(df, least=40).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 40)
    assert any(x["phrase"] == "in the long run" for x in got) and sum(x["phrase"] in {f"{v} {w}" for v in words for w in words} for x in got) == 64
    # all 64 pairs of letters are frequent and none of their some 500 runs of three is; the planted phrase leads two suffixes in a task
    assert 2 <= sum(made) <= 6


@pytest.mark.parametrize("least", [5, 300])
def test_counters_miss_no_frequent_run(spark, monkeypatch, least):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    monkeypatch.setattr(phrases, "RUN_BITS", (11, 11))  # too few counters
    rows = rows_for_phrases() + [(1000 + i, "over and over again. " * 260, "en", 1, 1, 1) for i in range(2)]  # full counters in each task
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, first=40).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, least, first=40)


def test_places_of_maps_of_all_sizes():
    for bits in (5, 9, 24, 27):
        assert phrases.bits_of(np.zeros(2 ** (bits - 5), np.uint32)) == bits
