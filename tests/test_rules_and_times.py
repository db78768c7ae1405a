"""Phrase automaton, suffix rules, start times and counted stages against plain versions."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from leadforge.functions.suffixes import with_registrable
from leadforge.operators import config
from leadforge.operators.phrasebook import canonical_names, first_phrase
from leadforge.operators.schedule import start_times
from leadforge.sources import runlog
from leadforge.sources.document import write_document


def test_automaton_equals_a_chain_of_conditions(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    phrases = [word(rng.randint(1, 4)) for _ in range(60)] + ["ab", "AB", "b"]
    texts = [word(rng.randint(0, 12)) for _ in range(300)] + [None, "", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r["k"]: r["p"] for r in df.select("k", first_phrase(F.col("t"), phrases).alias("p")).collect()}
    for k, t in enumerate(texts):
        assert found[k] == (None if t is None else next((i for i, p in enumerate(phrases) if p.lower() in t.lower()), None))
    aliases = [(p, f"name {i}") for i, p in enumerate(phrases)]
    got = sorted(map(tuple, canonical_names(df, "t", aliases).select("k", "name").collect()))
    assert got == sorted(map(tuple, df.select("k", config.canonical_name(F.col("t"), aliases).alias("name")).collect()))
    assert {r["p"] for r in df.where("k < 5").select(first_phrase(F.col("t"), ["nowhere", ""]).alias("p")).collect()} == {1}
    assert {r["p"] for r in df.select(first_phrase(F.col("t"), []).alias("p")).collect()} == {None}


def test_ten_thousand_aliases(spark):
    aliases = [(f"agency number {i:05d}x", f"A{i}") for i in range(10_000)]
    df = spark.range(500).select("id", F.format_string("By Agency  Number %05dX.", (F.col("id") * 21 % 10_500)).alias("raw"))
    rows = {r["id"]: r["name"] for r in canonical_names(df, "raw", aliases).collect()}
    assert all(rows[i] == (f"A{i * 21 % 10_500}" if i * 21 % 10_500 < 10_000 else f"By Agency Number {i * 21 % 10_500:05d}X") for i in range(500))


def test_suffix_rules_with_wildcards_and_exceptions(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "uk", "co.uk", "CO.UK ", "*.ck", "!www.ck", "ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "", None)], "rule string")
    cases = {
        "www.shop.co.uk": "shop.co.uk", "co.uk": None, "uk": None, "a.uk": "a.uk", "x.y.ck": "x.y.ck", "y.ck": None, "www.ck": "www.ck", "a.www.ck": "www.ck", "B.Example.COM": "example.com",
        "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "c.kawasaki.jp": None, "sub.city.kawasaki.jp": "city.kawasaki.jp", "host.unknown": "host.unknown", "unknown": None, "10.0.0.1": None, "a..com": None, ".com": None, "": None, None: None,
    }
    df = spark.createDataFrame([(h, 1) for h in cases for _ in range(2)], "host string, rule int")  # a column with a name of the rules' table
    rows = with_registrable(df, "host", rules).collect()
    assert len(rows) == 2 * len(cases) and {r["host"]: r["domain"] for r in rows} == cases
    assert {r["domain"] for r in with_registrable(df.where("host = 'a.uk' OR host = 'x.y.ck'"), "host", rules.limit(0)).collect()} == {"a.uk", "y.ck"}


def test_start_times_with_a_skewed_host(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([rng.randint(0, 400), rng.randint(0, 40)]) + rng.choice([0.0, 0.25])) for i in range(600)] + [(601, "a", None), (602, None, None)]
    df = spark.createDataFrame(rows, "id int, host string, s double").select("id", "host", F.timestamp_seconds("s").alias("at"), F.lit(1).alias("start_"))
    for host, block in (("host", 7), ("host", 100_000), (None, 13)):
        got = {r["id"]: r["w"] for r in start_times(df, host, "at", "id", 1.5, block).select("id", F.expr("unix_micros(start) / 1e6").alias("w")).collect()}
        free: dict = defaultdict(lambda: -1e9)
        for i, h, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
            h = h if host else "all"
            free[h] = max(s, free[h] + 1.5)
            assert got[i] == free[h], (i, h)
        assert len(got) == len(rows) and got[601] is None and got[602] is None


def test_counts_come_from_the_write_itself(spark, tmp_path):
    df = spark.range(100).withColumn("e", F.when(F.col("id") % 10 == 0, F.lit(True)))
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "one write and one line")
    for run in ("r1", "r2"):
        found = runlog.write_counted(df, f"{tmp_path}/{run}", "score", run, f"{tmp_path}/log", F.col("e"), F.col("id") < 15)
        jobs.append(len(tracker.getJobIdsForGroup("counted")))
        assert found == {"n_rows": 100, "ok": 77, "errors": 10, "skipped": 13} and spark.read.parquet(f"{tmp_path}/{run}").count() == 100
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert runlog.write_counted(df.limit(0), f"{tmp_path}/r3", "score", "r3", f"{tmp_path}/log", F.col("e"), F.col("id") < 15)["n_rows"] == 0
    assert sorted(tuple(r) for r in runlog.run_log(spark, f"{tmp_path}/log").collect()) == [("r1", "score", 100, 77, 10, 13), ("r2", "score", 100, 77, 10, 13), ("r3", "score", 0, 0, 0, 0)]


def test_configuration_files_keep_their_order(spark, tmp_path):
    (tmp_path / "angles.json").write_text('[\n {"key": "z", "when": ["https"], "guard": "expired", "text": "Zed."},\n {"key": "a", "when": [], "text": "Last."}\n]')
    found = config.angles(config.read_rows(spark, str(tmp_path / "angles.json"), config.ANGLES))
    assert [(a.key, a.when, a.guard) for a in found] == [("z", ("https",), "expired"), ("a", (), None)]
    (tmp_path / "aliases.json").write_text('{\n "_note": "raw -> name",\n "web solns": "Web Solutions",\n "web": "Other",\n "ab": "A B"}')
    assert config.pairs(config.read_map(spark, str(tmp_path / "aliases.json"))) == [("web solns", "Web Solutions"), ("web", "Other"), ("ab", "A B")]


def test_document_is_sorted_and_parses(spark, tmp_path):
    path = tmp_path / "out" / "index.json"
    df = spark.range(5_000).selectExpr("concat('d', id) AS domain", "id % 50 AS score", "if(id % 3 = 0, null, 'é \"q\"\n') AS name")
    order = [F.desc("score"), F.col("domain")]
    write_document(df, f"file://{path}", order, head={"city": "C", "n": 5_000}, parts=7)
    got = json.loads(path.read_text())
    assert got["city"] == "C" and [(r["score"], r["domain"]) for r in got["leads"]] == sorted(((i % 50, f"d{i}") for i in range(5_000)), key=lambda r: (-r[0], r[1]))
    assert got["leads"][0].keys() == {"domain", "score", "name"} and {r["name"] for r in got["leads"]} == {None, 'é "q"\n'}
    write_document(df.limit(0), f"file://{path}", order)
    assert json.loads(path.read_text()) == {"leads": []}
    write_document(df.where("domain = 'd7'"), f"file://{path}", order)
    assert len(json.loads(path.read_text())["leads"]) == 1 and [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["index.json"]
