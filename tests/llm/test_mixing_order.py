"""Training order of the mix against brute force."""

import hashlib
import re

import pytest

import corpus_pipeline
from leadforge.llm import mixing, queries
from leadforge.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, targets):
    """(id, reading, position) of every reading, from each source's stream and a bisection of its integrated schedule."""
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    out = []
    for i, name in enumerate(names):
        begin, end = mixing.SCHEDULES[i % 3]
        stream = sorted((hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), len(WORD.findall(r[1] or "")), r[0]) for r in rows if r[3] == name)
        start, target = 0, targets[name]
        for reading in (0, 1):
            for _, size, key in stream:
                taken = max(0, min(int(target + 0.5) - start, size))
                if taken > 0 and 2 * taken >= size:
                    share, low, high = min(1.0, (start + size / 2) / target), 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if begin * t + (end - begin) * t * t / 2 < share else (low, t)
                    out.append((key, reading, low))
                start += size
    return out


def test_positions(docs, rows):
    targets = {x["source"]: x["mix_target"] for x in mixing.assign(docs).select("source", "mix_target").collect()}
    got = mixing.readings(docs).select("doc_id", "mix_reading", "mix_position").collect()
    assert [x["mix_position"] for x in got] == sorted(x["mix_position"] for x in got)
    want = brute(rows, targets)

    def order(x):
        return repr(x[0]), x[1], x[2]

    got = sorted(map(tuple, got), key=order)
    want.sort(key=order)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_a_schedule_changes_the_registered_result(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = {(x["doc_id"], x["reading"]): x["position"] for x in queries.QUERIES["op2_mixing_order"](spark, str(tmp_path)).collect()}
    monkeypatch.setattr(mixing, "SCHEDULES", mixing.SCHEDULES[::-1])
    after = {(x["doc_id"], x["reading"]): x["position"] for x in queries.QUERIES["op2_mixing_order"](spark, str(tmp_path)).collect()}
    assert before.keys() == after.keys() and before != after


@pytest.mark.parametrize("reread", [True, False])
def test_place_survives_the_reread(spark, docs, reread):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mix = mixing.mixed(docs)
        mix = stored(mix) if reread else mix
        got = corpus_pipeline.encoding(spark, mix, "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({x["place"] for x in got}) == len(got)
    seen, places = set(), []
    for x in sorted(got, key=lambda x: x["place"]):
        if x["doc_id"] != 13:
            reading = int(x["doc_id"] in seen)
            seen.add(x["doc_id"])
            places.append((x["doc_id"], reading))
    want = mixing.readings(docs).where("doc_id is distinct from 13").select("doc_id", "mix_reading").collect()
    assert places == [tuple(x) for x in want] and len(places) > 30


def test_the_query_takes_its_words_and_positions_from_the_readings(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["op2_mixing"](spark, str(tmp_path)).collect()
    firsts = [x["first_position"] for x in rows]
    known = [x for x in firsts if x is not None]
    assert known == sorted(known) and firsts[: len(known)] == known
    order = {(x["doc_id"], x["reading"]): int(x["position"] * 1e9) for x in queries.QUERIES["op2_mixing_order"](spark, str(tmp_path)).collect()}
    for x in rows:
        for k, name in enumerate(("first_position", "second_position")):
            assert x["doc_id"] == 13 or x[name] == order.get((x["doc_id"], k))
        assert x["taken"] > 0 or x["first_position"] is None


def test_a_table_with_a_made_name_is_refused(docs):
    with pytest.raises(ValueError, match="mix_target"):
        mixing.assign(docs.withColumnRenamed("digest", "mix_target"))


def test_shares_follow_the_schedules(spark):
    """By training time t a source has given about the share of its target that its integrated schedule asks for."""
    rows = [(i, " ".join(["w"] * 10), "abc"[i % 3]) for i in range(1500)]
    got = mixing.readings(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for name, (begin, end) in zip("abc", mixing.SCHEDULES):
        own = [x for x in got if x["source"] == name]
        for t in (0.1, 0.35, 0.5, 0.8):
            words = sum(x["mix_size"] for x in own if x["mix_position"] <= t)
            assert words / own[0]["mix_target"] == pytest.approx(begin * t + (end - begin) * t * t / 2, abs=0.01)
