"""Lead assembly, contact rules, reports and configuration on small relations."""

import json

from pyspark.sql import functions as F

from leadforge.operators import assembly, config, report

BUSINESSES = "vertical string, domain string, arrival bigint, name string, rating double, review_count int, address string, phone string, skip_reason string, verdict string, raw_results int"
CONTACTS = "vertical string, domain string, kind string, value string, seq bigint, owner string"


def businesses(spark):
    rows = [
        ("v", "a.in", 1, "Old A", 4.0, 10, "", "0422 1", None, "audit", 9), ("v", "a.in", 5, "A", 4.5, 12, "", "098765 43210", None, "audit", 9), ("v", "b.in", 2, "", None, None, "Street", "98765 43210", None, None, 9),
        ("v", None, 3, "Nobody", 1.0, 1, "", "98765 00000", "aggregator-profile-only", None, 9), ("w", "c.in", 4, None, 0.0, 0, None, "123", None, "skip", 0),
    ]
    return spark.createDataFrame(rows, BUSINESSES)


def contacts(spark):
    rows = [("v", "b.in", "phone", "+91 98765-43210", 2, None), ("v", "b.in", "email", "X@b.in", 1, None), ("w", "c.in", "email", "x@B.in", 1, None), ("w", "c.in", "email", "own@c.in", 2, None), ("w", "c.in", "instagram", "c", 3, None)]
    return spark.createDataFrame(rows, CONTACTS)


def owned(spark):
    every = assembly.with_provider_phones(contacts(spark), businesses(spark))
    keyed = every.withColumns({"key": report.contact_key(F.col("kind"), F.col("value")), "credit": F.lit("")})
    return report.contact_owner(keyed).select("vertical", "domain", "kind", "value", "seq", "owner")


def test_provider_phones_only_fill_gaps_and_keep_their_owner(spark):
    got = {(x["domain"], x["kind"], x["value"]): x["owner"] for x in owned(spark).collect()}
    assert got == {
        ("a.in", "phone", "098765 43210"): "places", ("b.in", "phone", "+91 98765-43210"): "agency", ("b.in", "email", "X@b.in"): "agency",
        ("c.in", "email", "x@B.in"): "agency", ("c.in", "email", "own@c.in"): "business", ("c.in", "instagram", "c"): "business",
    }


def leads(spark):
    scores = spark.createDataFrame([("v", "a.in", 70, "A", "", [], "call"), ("v", "b.in", 70, "A", None, ["https"], None), ("w", "c.in", 10, "X", "no measurable pain", ["https"], "none"), ("w", "lone.in", 1, "X", None, [], "")], "vertical string, domain string, score int, tier string, gate string, flaws array<string>, pitch_angle string")
    signals = spark.createDataFrame([("v", "a.in", {"https": "ok"}), ("v", "b.in", {"https": "http only", "lcp": None}), ("w", "c.in", {}), ("w", "d.in", {})], "vertical string, domain string, signals map<string,string>")
    lists = assembly.contact_lists(owned(spark)).withColumn("page_address", F.when(F.col("domain") == "a.in", ""))
    links = spark.createDataFrame([("v", "b.in", 4, 'Studio "S"', None, "by Studio"), ("w", "c.in", 1, None, None, None)], "vertical string, domain string, links int, agency_name string, agency_domain string, credit string")
    return assembly.assemble(scores, signals, businesses(spark), lists, links)


def test_leads_are_those_with_signals_and_score(spark):
    got = {x["domain"]: x for x in leads(spark).collect()}
    assert set(got) == {"a.in", "b.in", "c.in"}
    assert [(x["name"], x["rating"], x["reviews"], x["address"], x["gate"], x["pitch_angle"], x["agency"] is None) for x in (got["a.in"], got["b.in"], got["c.in"])] == [
        ("A", 4.5, 12, "none", None, "call", True), ("b.in", 0.0, 0, "Street", None, "", False), ("c.in", 0.0, 0, "none", "no measurable pain", "none", True),
    ]
    index = {x["domain"]: x for x in assembly.index_leads(leads(spark), F.array(F.lit("r"))).collect()}
    assert [c["value"] for c in index["c.in"]["contacts"]] == ["own@c.in", "c"] and index["a.in"]["contacts"] == []
    assert index["b.in"]["agency"]["credit"] == "by Studio" and index["b.in"]["shots"]["full"] == "v/b.in/full.webp"


def test_reports(spark):
    rows = assembly.lead_rows(leads(spark))
    assert rows.columns == list(assembly.LEAD_COLUMNS)
    lines = {x["domain"]: x["line"] for x in rows.select("domain", assembly.csv_line(rows).alias("line")).collect()}
    assert lines["b.in"] == '"A","70","v","b.in","b.in","Street","","","0.0","0","Studio ""S""",""'
    marks = spark.createDataFrame([("c.in", None, True, None), ("a.in", "B", False, "x"), ("zz", "A", True, "")], "domain string, human_tier string, pitch boolean, note string")
    (pitch,) = assembly.pitch_rows(leads(spark), marks).collect()
    assert (pitch["domain"], pitch["email"], pitch["your_tier"], pitch["note"]) == ("c.in", "own@c.in", "", "")
    merged = {x["domain"]: tuple(x)[1:] for x in assembly.merged_reviews(leads(spark), marks, marks.where("domain = 'a.in'").withColumn("human_tier", F.lit("X"))).collect()}
    assert merged == {"a.in": ("X", False, "x"), "b.in": (None, False, ""), "c.in": (None, True, "")}
    assert assembly.grid(leads(spark).join(assembly.merged_reviews(leads(spark), marks, marks.limit(0)), "domain"), "unreviewed").count() == 2
    agencies = spark.createDataFrame([("S", "s.in", 2, 3, [("basic", "Rs 5"), ("plus", "Rs 9")], None), ("T", "t.in", 0, 0, [], "x")], "name string, domain string, built_in_run int, portfolio_clients int, pricing array<struct<tier:string,price:string>>, note string")
    assert [x["published_pricing"] for x in assembly.agency_rows(agencies).orderBy("domain").collect()] == ["basic Rs 5 | plus Rs 9", ""]
    assert {(x["domain"], x["signal"], x["flaw"]) for x in assembly.deck_signals(leads(spark)).collect()} == {("a.in", "https", False), ("b.in", "https", True)}


def test_counts_and_checks(spark):
    b = businesses(spark)
    verticals = spark.createDataFrame([("w", "W", 1, True), ("v", "V", 2, True), ("u", "U", 3, True), ("x", "X", 0, False)], "vertical string, label string, priority int, enabled boolean")
    assert [tuple(x) for x in assembly.vertical_index(verticals, b).collect()] == [("w", "W", 1, 1, 1, 0), ("v", "V", 2, 9, 3, 2), ("u", "U", 3, 0, 0, 0)]
    scores = spark.createDataFrame([("v", "a.in"), ("v", "nope.in")], "vertical string, domain string")
    assert [tuple(x) for x in assembly.stage_counts(assembly.matched(scores, b)).collect()] == [("v", 1, 1)]
    marks = spark.createDataFrame([("a.in", "A"), ("a.in", "Q"), ("../x", None), (None, None), ("new.in", "B"), ("nope.in", None)], "domain string, human_tier string")
    got = {(x["domain"], x["human_tier"]): x["error"] for x in assembly.checked_marks(marks, b, scores).collect()}
    assert got == {("a.in", "A"): None, ("a.in", "Q"): "human_tier must be A|B|C|X|null", ("../x", None): "Invalid domain", (None, None): "Invalid domain", ("new.in", "B"): "Unknown domain", ("nope.in", None): None}
    links = spark.createDataFrame([("a", f"/{i}", i, "internal") for i in range(50)] + [("a", "http://x/", 0, "external")], "site string, href string, pos int, kind string")
    statuses = spark.createDataFrame([("/1", 404), ("/39", 500), ("/40", 404), ("/2", None), ("http://x/", 404)], "href string, status int")
    assert tuple(assembly.dead_links(links, statuses, "site").first()) == ("a", 51, 50, 1, 0, 2)


def test_configuration_tables(spark, tmp_path):
    (tmp_path / "angles.json").write_text(json.dumps([{"ordinal": 1, "key": "late", "when": ["lcp"], "text": "Slow."}, {"ordinal": 0, "key": "expired", "when": ["https"], "guard": "expired", "text": "Warned."}, {"ordinal": 2, "key": "any", "when": [], "text": "Other."}]))
    choices = config.angles(config.read_rows(spark, str(tmp_path / "angles.json"), config.ANGLES))
    assert [a.key for a in choices] == ["expired", "late", "any"]
    rows = [(["https"], "Expired 2020", None), (["https", "lcp"], "http only", ""), ([], None, None), (["https"], None, "young domain"), ([], "ok", "no measurable pain")]
    df = spark.createDataFrame(rows, "flags array<string>, https string, gate string")
    picked = [tuple(x[0]) for x in df.select(config.pick_angle(F.col("flags"), {"https": F.col("https"), "lcp": F.lit("x")}, F.col("gate"), choices)).collect()]
    assert picked == [("expired", "Warned."), ("late", "Slow."), ("any", "Other."), ("gate", "Gate: young domain."), ("gate", "No measurable pain. Skip.")]
    said = [x[0] for x in df.select(config.reasons(F.col("flags"), F.col("gate"), [("https", "Unsafe.")])).collect()]
    assert said == [["Unsafe."], ["Unsafe."], [], [], []]
    names = spark.createDataFrame([(" web   soLutions by cbe., ",), ("PIXEL frames",), (None,)], "n string")
    assert [x[0] for x in names.select(config.canonical_name(F.col("n"), [("pixel", "Pixel House")])).collect()] == ["Web SoLutions By Cbe.,", "Pixel House", None]
