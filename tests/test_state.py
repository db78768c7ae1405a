"""Recorded answers as a data source, keyed tables, review marks in a state store, incremental stages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leadforge.sources import html_table, outputs, recorded
from leadforge.sources.keyed import KeyedTable
from leadforge.sources.lead_store import LeadStore
from leadforge.streaming import marks, resume

MARK = "domain string, human_tier string, pitch boolean, note string, reviewed_at string"


def lines(folder, *texts):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-{len(os.listdir(folder))}.json", "w") as f:
        f.write("\n".join(texts))


def test_recorded_source_plans_the_searches_that_filters_leave(spark, tmp_path):
    place = json.dumps({"id": "p1", "displayName": {"text": "A"}, "rating": "no number"})
    lines(tmp_path / "vertical=a b%2Fc/tile=0/keyword=x", place, "oops", "", "[1]", '{"id": ')
    lines(tmp_path / "vertical=d/tile=1/keyword=x", place)
    found = recorded.read_source(spark, "recorded", path=f"file://{tmp_path}", verticals="a b/c,d", keywords="x,y", tiles="3")
    assert found.rdd.getNumPartitions() == 12  # a partition for each vertical, tile and keyword
    one = found.where((F.col("vertical") == "d") & F.col("tile").isin(0, 1))
    assert one.rdd.getNumPartitions() == 4
    assert [tuple(r) for r in recorded.listings(one).select("vertical", "tile", "provider_id", "name", "rating").collect()] == [("d", 1, "p1", "A", None)]
    rows = sorted((r["vertical"], r["provider_id"] or "") for r in recorded.listings(found).collect())
    assert rows == [("a b/c", ""), ("a b/c", "p1"), ("d", "p1")]  # a broken object is a row without fields; other lines are none
    assert found.where("vertical = 'nowhere'").count() == 0
    assert recorded.listings(found).where("name = 'A' AND tile = 1").count() == 1  # a filter that is not pushed down still holds
    with pytest.raises(ValueError, match="unknown source"):
        recorded.read_source(spark, "places")
    with pytest.raises(Exception, match="need the options"):
        recorded.read_source(spark, "recorded", path="x").count()


def files(table):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(table) for n in names if n.endswith(".parquet")}


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_keyed_table_writes_the_batch_and_only_crowded_buckets_are_compacted(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = KeyedTable(spark, f"file://{path}", "k bigint, a string, b string", ["k"], buckets=4)
    assert table.read().count() == 0
    table.upsert(spark.range(20_000).selectExpr("id AS k", "md5(string(id)) AS a", "md5(string(-id)) AS b"))
    first = files(path)
    for i in range(3):
        table.upsert(spark.createDataFrame([(7, f"new{i}", None)], "k bigint, a string, b string"))
    later = {f: n for f, n in files(path).items() if f not in first}
    assert len(later) == 3 and sum(later.values()) < sum(first.values()) / 20 and files(path).items() >= first.items()
    before = content(table)
    assert len(before) == 20_000 and (7, "new2", None) in before
    version = table.compact(2)  # one bucket of four has more than two deltas
    assert content(table) == before and version.number == 5
    assert sum(os.path.getsize(f) for f in files(path) if f not in first and f not in later) < sum(first.values()) / 2
    assert table.clean() == 3 and content(table) == before and table.compact(2) == version


def test_keyed_table_kinds_of_writes_and_ties(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k string, a int, b int", ["k"], buckets=3)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, a int, b int")
    table.upsert(rows(("x", 1, 1), (None, 5, 5), ("x", 2, 0), ("x", 2, None)), "replace", ["a"])
    assert content(table) == [("x", 2, 0), (None, 5, 5)]
    table.upsert(rows(("x", 9, 9), ("y", 3, 3), ("y", 2, 8)), "ignore", ["a"])
    table.upsert(rows((None, 6, None), ("z", 4, None)).drop("b"), "update")
    table.upsert(rows(("z", 8, 8), ("y", 8, 8)), "ignore")
    assert content(table) == [("x", 2, 0), ("y", 2, 8), ("z", 4, None), (None, 6, 5)]
    table.upsert(rows().limit(0))
    assert content(table.compact(0) and table) == [("x", 2, 0), ("y", 2, 8), ("z", 4, None), (None, 6, 5)]
    assert [tuple(r) for r in table.lookup(rows((None, 0, 0), ("x", 0, 0), ("w", 0, 0))).select("k").orderBy("k").collect()] == [(None,), ("x",)]
    with pytest.raises(ValueError, match="unknown kind"):
        table.upsert(rows(), "merge")
    with pytest.raises(ValueError, match="needs its keys"):
        table.upsert(rows().drop("k"))


def test_a_write_that_ends_before_its_commit_is_never_read(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k int, a int", ["k"])
    batch = lambda a: spark.createDataFrame([(1, a)], "k int, a int")
    table.upsert(batch(1))
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(batch(2))
    monkeypatch.undo()
    assert content(table) == [(1, 1)]
    stale = table.version()
    table.upsert(batch(3))
    assert content(table) == [(1, 3)] and table.clean() == 1 and content(table) == [(1, 3)]
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(type(stale)(stale.number + 1, stale.buckets, stale.folders))


def run_marks(spark, root, at_once=1):
    query = marks.keep_marks(marks.mark_files(spark, f"file://{root}/in", at_once), f"file://{root}/table", f"file://{root}/checkpoint")
    query.awaitTermination()
    return query


def test_marks_survive_restarts_and_late_or_equal_marks(spark, tmp_path):
    mark = lambda domain, tier, at, seq: json.dumps({"domain": domain, "human_tier": tier, "pitch": True, "reviewed_at": at, "seq": seq})
    lines(tmp_path / "in", mark("a", "A", "2024-05", 1), mark("b", "B", "2024-05", 1), mark("c", None, None, None))
    run_marks(spark, tmp_path)
    lines(tmp_path / "in", mark("a", "C", "2024-04", 9), mark("b", "X", "2024-05", 2), mark("b", "A", "2024-05", 2))
    query = run_marks(spark, tmp_path)  # a restart: the late mark of `a` meets the state of the run before
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3
    rows = {r["domain"]: (r["human_tier"], r["reviewed_at"], r["pitch"]) for r in marks.current(spark, f"file://{tmp_path}/table").collect()}
    assert rows == {"a": ("A", "2024-05", True), "b": ("X", "2024-05", True), "c": (None, None, True)}
    changes = spark.read.parquet(f"file://{tmp_path}/table").count()

    lines(tmp_path / "in", mark("a", "A", "2024-05", 1), mark("b", "X", "2024-05", 2))  # the same marks again
    run_marks(spark, tmp_path)
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == changes == 4


def test_a_stage_does_new_files_only_and_passes_finished_rows_through(spark, tmp_path):
    def run():
        query = resume.run_stage(spark, f"file://{tmp_path}/in", "n int, verdict string", F.col("verdict") == "done", lambda rows: {"verdict": F.lit("worked"), "note": F.concat(F.lit("was "), rows["n"])}, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        query.awaitTermination()
        return resume.rows_read(query)

    lines(tmp_path / "in", '{"n": 3}', '{"n": 1, "verdict": "done"}')
    assert run() == 2
    lines(tmp_path / "in", '{"n": 2, "verdict": "open"}')
    assert run() == 1 and run() == 0
    rows = [(r["n"], r["verdict"], r["note"]) for r in resume.in_first_order(spark, f"file://{tmp_path}/out", "n").collect()]
    assert rows == [(1, "done", None), (2, "worked", "was 2"), (3, "worked", "was 3")]


def test_stages_never_write_reviews_and_lists_are_json(spark, tmp_path):
    store = LeadStore(spark, f"file://{tmp_path}/db", buckets=2)
    store.review(spark.createDataFrame([("a.in", "A", True, "", "2024-01"), ("a.in", "B", None, "x", "2024-02")], MARK))
    store.review(spark.createDataFrame([("a.in", "C")], "domain string, human_tier string").selectExpr("*", "'2024-03' AS reviewed_at"))
    assert [tuple(r) for r in store.read("reviews").collect()] == [("a.in", "C", 0, "x", "2024-03")]
    with pytest.raises(ValueError, match="do not write reviews"):
        store.write("reviews", spark.range(1))
    agency = spark.createDataFrame([("g.in", ["9,000", "1"], 3, "extra"), ("h.in", None, 0, "extra")], "domain string, pricing array<string>, portfolio_clients int, other string")
    store.write("agencies", agency)
    assert sorted(tuple(r) for r in store.read("agencies").collect()) == [("g.in", None, '["9,000","1"]', 3, None), ("h.in", None, None, 0, None)]
    store.write("businesses", spark.createDataFrame([("a.in", "first")], "domain string, name string"))
    store.write("businesses", spark.createDataFrame([("a.in", "second"), ("b.in", "new")], "domain string, name string"))
    assert sorted((r["domain"], r["name"]) for r in store.read("businesses").collect()) == [("a.in", "first"), ("b.in", "new")]


def test_outputs_come_from_one_parse(spark, tmp_path):
    pages = [
        (1, "https://www.one.in/", '<body><a href="tel:+919876512345">call</a><a href="https://instagram.com/p.studio">i</a><a href="/x?p=1#top">x</a><form action="/f" method="post"></form></body>'),
        (2, "https://two.in/", '<body>9876512345 <a href="https://instagram.com/p/abc">post</a><a href="https://facebook.com/share.in?x">f</a> hello@two.in</body>'), (3, "https://three.in/", None),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("kind", F.lit("clash"))
    plan = outputs.tagged(df, "page_id", "html")._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("MapInPandas") == 1
    out = outputs.write_outputs(df, f"file://{tmp_path}/out")
    assert sorted((r["page_id"], r["quoteForm"]) for r in out.signals.collect()) == [(1, "contact form"), (2, "none")]
    assert out.links.where("page_id = 1 AND kind = 'internal'").select("href").head()[0] == "https://www.one.in/x?p=1"
    owned = {(r["domain"], r["kind"], r["key"]): r["owner"] for r in out.owned.collect()}
    assert owned == {
        ("one.in", "phone", "9876512345"): "agency", ("two.in", "phone", "9876512345"): "agency", ("one.in", "instagram", "p.studio"): "business",
        ("two.in", "facebook", "share.in"): "business", ("two.in", "email", "hello@two.in"): "business",
    }


def test_html_elements_as_a_table_function(spark):
    html_table.register(spark)
    spark.createDataFrame([(1, "<p>x<a href='/u'>y</a>"), (2, None), (3, "")], "k int, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT k, e.* FROM some_pages, LATERAL html_elements(html, 'tag,pos') e ORDER BY k, pos")
    assert rows.columns == ["k", "tag", "pos"] and [tuple(r) for r in rows.collect()] == [(1, "p", 0), (1, "a", 1)]
    every = spark.sql("SELECT e.* FROM some_pages, LATERAL html_elements(html) e WHERE tag = 'a'").head()
    assert every["attrs"] == {"href": "/u"} and every["text"] == "y"
    with pytest.raises(Exception, match="unknown columns"):
        spark.sql("SELECT * FROM html_elements('<p>', 'nothing')").collect()
