"""Contacts, credits, agencies, sources and documents of sites, on small cases."""

import pytest
from pyspark.sql import functions as F

from leadforge.operators import assembly, links, report, signals
from leadforge.sources import html, listings, sinks


def elements(spark, *pages):
    return html.html_elements(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html")


@pytest.mark.parametrize("text,numbers", [
    ("Office 0422-2345678", ["4222345678"]), ("+91 422 234567.", ["422234567"]), ("0422 23456", []), ("422 23456789", []), ("9422345678", ["9422345678"]),
    ("98765 43210", []), ("09876543210 or 0422-2345678 or 422 2345678", ["9876543210", "4222345678"]),
])
def test_mobiles_before_numbers_of_the_city(spark, text, numbers):
    rows = links.contacts(elements(spark, f"<body><p>{text}</p></body>"), "id").orderBy("stage", "pos", "i").collect()
    assert [r.norm for r in rows] == numbers


def test_a_footer_by_class_or_id_has_credits_too(spark):
    got = links.agency_credits(elements(
        spark, "<div class='site-footer'>Website by Big Idea.</div><footer>Built by Others</footer>", "<div id='footer2'>A unit of Small  Group!</div>", "<div class='foot'>Website by Nobody</div>", "<p>plain"
    ), "id").collect()
    assert {(r.id, r.name, r.raw_text) for r in got} == {(0, "Big Idea", "Website by Big Idea."), (1, "Small Group", "A unit of Small  Group!")}


def test_agencies_have_their_first_name_and_a_row_for_each_client(spark):
    rows = [(3, "c.in", "pixel labs,", "pixel.com", "z"), (1, "a.in", "Pixel  Labs India", "pixel.com", "x"), (2, "b.in", "old mill works", None, "y"), (4, "b.in", "The OLD MILL", "", "w"), (5, "d.in", None, None, None)]
    table, clients = report.agency_directory(spark.createDataFrame(rows, "lead_no long, domain string, credit_name string, credit_domain string, raw_text string"), [("old mill", "Old Mill Media")])
    assert {tuple(r) for r in table.select("agency", "name", "domain", "raw_text", "built_in_run").collect()} == {("pixel.com", "Pixel Labs India", "pixel.com", "x", 2), ("old mill media", "Old Mill Media", None, "y", 2)}
    assert {tuple(r) for r in clients.collect()} == {("pixel.com", "a.in"), ("pixel.com", "c.in"), ("old mill media", "b.in")}


def test_what_was_measured_or_given_goes_before_the_page(spark):
    page = signals.page_signals(elements(spark, "<meta name='viewport'><link href='/wp-content/themes/Flat/s.css'>", "<p>x", "<meta name='viewport'>"), "id")
    seen = spark.createDataFrame([(0, False, "2020"), (1, True, None), (2, None, None)], "id long, viewport_meta boolean, redesigned_given string")
    nothing = {"overflow_px": "int", "tap_targets": "int", "lcp_ms": "double", "transfer_bytes": "bigint", "videos": "array<struct<url:string,bytes:bigint>>", "broken": "array<string>", "wayback_first": "string", "https_ok": "boolean", "cert_expires": "date", "final_url": "string"}
    seen = seen.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    got = {r.id: r for r in signals.with_capture(page.join(seen, "id"), 2026, "2026-01-01", [("flat", "Market")]).collect()}
    assert [got[i].viewport for i in range(3)] == ["missing", "present", "present"] and [got[i].redesigned for i in range(3)] == ["2020", "n/a", "n/a"]
    assert [got[i].theme for i in range(3)] == ["Flat (Market)", "none", "none"] and got[0].https == "none - http only"


def test_the_first_readable_source_and_none(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "last"))
    (tmp_path / "empty").mkdir()
    places = [("service", str(tmp_path / "no")), ("run", str(tmp_path / "empty")), ("made up", str(tmp_path / "last"))]
    assert {(r.source, r.synthetic) for r in listings.first_of(spark, places).collect()} == {("made up", True)}
    with pytest.raises(ValueError):
        listings.first_of(spark, places[:2])


def test_images_are_limited_by_path(spark, tmp_path):
    for i in range(4):
        folder = tmp_path / "decor" / f"site{i}.in"
        folder.mkdir(parents=True)
        (folder / "full.png").write_bytes(b"x" * (i % 2))
        (folder / "notes.txt").write_bytes(b"x")
        (folder / "mobile.JPG").write_bytes(b"xy")
    found = listings.images(spark, str(tmp_path))
    assert found.count() == 6 and {r.bytes for r in found.where("shot = 'mobile'").collect()} == {2}
    assert [(r.vertical, r.domain, r.shot) for r in listings.images(spark, str(tmp_path), 3).collect()] == [("decor", "site0.in", "mobile"), ("decor", "site1.in", "full"), ("decor", "site1.in", "mobile")]


def test_a_run_of_one_vertical_keeps_the_documents_of_others(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "w", "x.in", None), ("a", 2, "w", None, "aggregator-profile-only"), ("b", 1, "v", "y.in", None)], "vertical string, tile int, keyword string, domain string, skip_reason string")
    for run, part in (("run-1", rows), ("run-2", rows.where("vertical = 'b'"))):
        sinks.write_document(part, sinks.document_head(part, run, "recorded", "2026"), str(tmp_path / "found"))
    head = {r.vertical: (r.run, r.tiles, r.keywords, r.raw_results, r.with_domain, r.greenfield) for r in listings.stage_rows(spark, str(tmp_path / "found" / "head")).collect()}
    assert head == {"a": ("run-1", 2, 1, 2, 1, 1), "b": ("run-2", 1, 1, 1, 1, 0)}
    assert listings.stage_rows(spark, str(tmp_path / "found" / "rows")).count() == 3


def test_saved_columns(spark):
    lead = "vertical string, domain string, name string, rating double, reviews long, address string, score int, tier string, pitch_angle string, contacts array<struct<kind string, value string, owner string>>, agency struct<name string, domain string>"
    leads = spark.createDataFrame([("v", "x.in", 'A "b"', 4.5, 3, None, 7, "A", "slow", [("phone", "98", "business")], None)], lead)
    marks = spark.createDataFrame([("x.in", True, "B", None)], "domain string, pitch boolean, human_tier string, note string")
    rows = assembly.saved_rows(leads, marks)
    assert tuple(rows.columns) == assembly.SAVED_COLUMNS
    assert rows.select(assembly.csv_line(rows)).first()[0] == '"x.in","A ""b""","v","","98","","4.5","3","A","7","B","slow","",""'
