"""Listings, sites and saved pages: dedupe, classes, robots, signals, links, sources, sinks, stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadforge.functions import strings, urls
from leadforge.operators import classify, dedupe, links, robots, signals
from leadforge.sources import html, listings, sinks
from leadforge.streaming import reviews


def fold(rows):
    """The merge as a plain loop: rows (id, domain, reviews, phone) in arrival order."""
    best, seen = {}, {}
    for ident, domain, count, phone in rows:
        if domain not in best:
            best[domain], seen[domain] = [ident, count, phone], []
        elif (count or 0) > (best[domain][1] or 0):
            seen[domain].append(best[domain][0])
            best[domain] = [ident, count, phone or best[domain][2]]
        else:
            seen[domain].append(ident)
            best[domain][2] = best[domain][2] or phone
    return {d: (*b, seen[d]) for d, b in best.items()}


def test_merge_equals_the_fold(spark):
    rng = random.Random(2)
    rows = [(i, f"d{rng.randint(0, 30)}", rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["", f"p{i}"])) for i in range(300)]
    df = spark.createDataFrame([(i, i, d, c, p) for i, d, c, p in rows], "provider_id bigint, arrival bigint, domain string, review_count bigint, phone string")
    got = {x.domain: (x.provider_id, x.review_count, x.phone, x.also_seen_as) for x in dedupe.merge_by_domain(df, F.lit(False)).collect()}
    assert got == fold(rows)
    portal = df.withColumn("domain", F.lit("99acres.com")).limit(40)
    assert dedupe.merge_by_domain(portal, F.lit(True)).count() == 40
    assert [x.provider_id for x in dedupe.keep_first(df, "domain", "arrival").where("domain = 'd1'").collect()] == [next(i for i, d, _, _ in rows if d == "d1")]


@pytest.mark.parametrize("url,domain", [("https://www.shop.co.in/a", "shop.co.in"), ("http://a.b.example.co.uk", "example.co.uk"), ("https://X.Example.COM:80/", "example.com"), ("http://10.0.0.1/", None), ("http://localhost/", None), ("not a url", None), (None, None), ("http://co.in/", None)])
def test_registrable(spark, url, domain):
    assert spark.createDataFrame([(url,)], "u string").select(urls.registrable(F.col("u"))).first()[0] == domain


def test_urls_and_strings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.clean_href(F.lit("https://a.in/x?utm_source=f&a=1&gclid=2#top"))) == "https://a.in/x?a=1" and one(urls.clean_href(F.lit("https://a.in/?fbclid=1"))) == "https://a.in/"
    assert one(strings.phone_key(F.lit("+91 98765-43210"))) == one(strings.phone_key(F.lit("098765 43210"))) == "9876543210" and one(strings.phone_key(F.lit("9187654321"))) == "9187654321"
    assert one(strings.csv_cell(F.lit('a "b"'))) == '"a ""b"""' and one(strings.csv_cell(F.lit(None))) == '""'
    assert one(strings.tidy_name(F.lit("  big  iDEA labs., "))) == "Big IDEA Labs" and one(strings.slug(F.lit("False Ceiling (new)"))) == "false-ceiling-new"
    assert one(strings.html_escaped(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;" and one(strings.phone_shown(F.lit("9876543210"))) == "+91 98765 43210"


def test_classes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(classify.skip_reason(F.lit("https://www.99acres.com/x"))) == "aggregator-profile-only" and one(classify.skip_reason(F.lit("https://m.facebook.com/x"))) == "aggregator-or-social-only"
    assert one(classify.skip_reason(F.lit("https://sites.google.com/x"))) == "aggregator-or-social-only" and one(classify.skip_reason(F.lit("https://shop.in"))) is None
    site, away = F.lit("https://a.in/"), F.lit("https://facebook.com/a")
    v = lambda *a: tuple(one(classify.verdict(*a)))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None)
    assert v(no, F.lit("e"), none.cast("int"), site, site, yes) == ("skip", "robots-disallow") and v(yes, F.lit("e"), none.cast("int"), site, site, yes) == ("skip", "probe-error")
    assert v(yes, none, none.cast("int"), site, site, yes) == ("skip", "dead-host") and v(yes, none, F.lit(404), away, site, yes) == ("skip", "http-error")
    assert v(yes, none, F.lit(200), away, site, yes) == ("skip", "redirected-to-facebook.com") and v(yes, none, F.lit(200), site, site, yes) == ("skip", "parked") and v(yes, none, F.lit(200), site, site, no) == ("audit", None)
    assert one(classify.is_parked(F.lit("<p>Coming Soon</p>"), F.lit(600))) and not one(classify.is_parked(F.lit("<img>coming"), F.lit(100))) and one(classify.is_parked(F.lit("hi"), F.lit(10)))
    assert one(classify.certificate_status(F.lit("Dec  7 10:00:00 2023 GMT"), F.lit("2026-09-18").cast("timestamp"))) == "expired 2023-12" and one(classify.certificate_status(F.lit(None).cast("string"), F.lit("2026-09-18").cast("timestamp"))) == "none"
    assert one(classify.error_kind(F.lit("net::ERR_CONNECTION_REFUSED"), none.cast("int"))) == "refused" and one(classify.error_kind(none.cast("string"), F.lit(403))) == "blocked-403"


def test_robots(spark):
    body = "User-agent: Other\nUser-agent: leadbot\n\nDisallow: /a # no\nAllow: /a/b\n\nUser-agent: *\nDisallow: /"
    df = spark.createDataFrame([("x", body), ("y", None), ("z", "User-agent: *\nDisallow: /q\nAllow: /q")], "host string, body string")
    rules = robots.robots_rules(df, "LeadBot")
    ask = lambda p: {x.host: x.ok for x in rules.select("host", classify.robots_allowed(F.lit(p), F.col("allow"), F.col("disallow")).alias("ok")).collect()}
    assert ask("/a/c") == {"x": False, "y": True, "z": True} and ask("/a/b/c")["x"] and ask("/")["x"] and ask("/q")["z"]


PAGE = """<html><head><meta name="viewport" content="w"><link href="/wp-content/themes/Bold/style.css?ver=4.9.1"><link href="http://cdn/x.css">
<script src="/js/jquery-1.12.4.min.js"></script><script src="/wp-content/plugins/revslider/revslider-5.2.1.js"></script><style>/* Bootstrap v3.3.7 */</style></head>
<body><nav><a href="/blog?utm_source=x">Our blog</a> 2021<a href="/blog#c">again</a><a href="javascript:x">no</a></nav><p><a href="tel:+91 98765 43210">call</a> or 98765 43210 or 9876543210, mail INFO@Shop.in or noreply@shop.in
<a class="whats-app float" href="https://wa.me/919876543210">chat</a><a href="https://instagram.com/shop_x/">i</a><a href="https://facebook.com/sharer?u=1">s</a></p><img src=" "><form class="wpforms" method="post" action="/send"></form>
<footer>&copy; 2012 - 2019 Shop. Website designed by big idea labs. <a href="https://bigidea.in/">x</a></footer>"""


def test_page_signals(spark):
    pages = spark.createDataFrame([(1, "https://www.shop.in/home", PAGE), (2, "http://b.in/", "<p>plain"), (3, None, None)], "id bigint, url string, html string")
    e = html.html_elements(pages, "id", "html").cache()
    x = {r.id: r for r in signals.page_signals(e, "id").collect()}
    assert set(x) == {1, 2}
    a = x[1]
    assert (a.copyright, a.jquery, a.bootstrap, a.slider, a.generator, a.theme, a.viewport, a.mixedContent, a.empty_images) == ("2019", "1.12.4", "3.3.7", "revslider 5.2.1", "WordPress 4.9.1", "Bold", "present", "1 assets", 1)
    assert (a.whatsapp, a.quoteForm, a.blog) == ("float button", "wpforms", "last post 2021")
    b = x[2]
    assert (b.copyright, b.jquery, b.bootstrap, b.slider, b.generator, b.theme, b.viewport, b.mixedContent, b.whatsapp, b.quoteForm, b.blog) == ("none", "none", "none", "none", "static html", "none", "missing", "none", "none", "none", "none")
    found = links.links(e, pages, "id")
    got = {r.href: (r.kind, r.region) for r in found.collect()}
    assert got["https://www.shop.in/blog"] == ("internal", "nav") and got["https://bigidea.in/"] == ("external", "footer") and got["https://wa.me/919876543210"] == ("social", "main") and "javascript:x" not in got
    assert links.link_counts(found, "id").first()["socials"] == 3 and links.probe_queue(found, "id", 1).count() == 1
    assert {(r.kind, r.norm) for r in links.contacts(e, "id").collect()} == {("phone", "9876543210"), ("email", "info@shop.in"), ("whatsapp", "919876543210"), ("instagram", "shop_x")}
    assert [r.name for r in links.agency_credits(e, "id").collect()][0].startswith("Big Idea Labs")


def test_capture_signals(spark):
    page = signals.page_signals(html.html_elements(spark.createDataFrame([(1, PAGE)], "id bigint, html string"), "id", "html"), "id")
    seen = spark.createDataFrame([(1, 142, 19, 8400.0, 11744051, [("v.webm", 6396313)], ["/send", "a.png"], "2015", True, None, "https://x/")], "id bigint, overflow_px int, tap_targets int, lcp_ms double, transfer_bytes bigint, videos array<struct<url string, bytes bigint>>, broken array<string>, wayback_first string, https_ok boolean, cert_expires date, final_url string")
    x = signals.with_capture(page.join(seen, "id"), 2026, "2026-09-18").first()
    assert (x.overflow, x.tapTargets, x.lcp, x.pageWeight, x.heroVideo, x.https, x.mixedContent, x.brokenImages, x.quoteForm, x.domainAge, x.redesigned) == ("+142px", "19 under 44px", "8.4s", "11.2 MB", "6.1 MB webm", "ok", "1 assets", "2", "broken", "11 yr", "2019")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "decor-tile3-false-ceiling.json").write_text(json.dumps([{"provider_id": "p1", "name": "A", "rating": 4.5, "review_count": 87}, {"provider_id": "p2", "name": "B"}]))
    rows = listings.recorded_listings(spark, str(tmp_path / "in"), "decor")
    assert [(x.provider_id, x.tile, x.keyword, x.review_count) for x in rows.orderBy("provider_id").collect()] == [("p1", 3, "false-ceiling", 87), ("p2", 3, "false-ceiling", None)]
    assert spark.createDataFrame([("{bad",), (None,), ('{"a": 1}',)], "t string").select(F.max(listings.tolerant(F.col("t"), "a int")["a"])).first()[0] == 1
    sinks.write_stage(rows, str(tmp_path / "stage"))
    sinks.write_stage(rows.withColumn("vertical", F.lit("other")), str(tmp_path / "stage"))
    assert listings.stage_rows(spark, str(tmp_path / "stage")).count() == 4 and listings.stage_rows(spark, str(tmp_path / "stage"), "decor").count() == 2
    sinks.write_csv(spark.createDataFrame([('say "x"', None, 3)], "a string, b string, c int"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*.txt")
    assert part.read_bytes() == '﻿"a","b","c"\r\n"say ""x""","","3"\r\n'.encode()
    good, bad = sinks.split_errors(spark.createDataFrame([("a", 1), ("b", None)], "domain string, n int"), F.when(F.col("n").isNull(), F.lit("no reviews")), "score")
    assert good.count() == 1 and tuple(bad.first()) == ("b", "score", "no reviews")


def test_review_stream(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("marks", "table", "check"))
    (tmp_path / "marks").mkdir()

    def add(name, *rows):
        (tmp_path / "marks" / name).write_text("".join(json.dumps(dict(zip(("domain", "human_tier", "pitch", "note", "reviewed_at", "seq"), r))) + "\n" for r in rows))
        reviews.upsert_marks(spark, source, table, check).awaitTermination()
        return {x.domain: x.human_tier for x in reviews.current(spark, table).collect()}

    assert add("1.json", ("a.in", "A", True, "", "2026-01-01", 1), ("a.in", "B", True, "", "2026-01-02", 2), ("b.in", "C", False, "", "2026-01-01", 3)) == {"a.in": "B", "b.in": "C"}
    assert add("2.json", ("b.in", "X", False, "", "2026-02-01", 4)) == {"a.in": "B", "b.in": "X"}
    check = str(tmp_path / "another check")  # reads all files anew: what the table holds stays, later marks win
    assert add("3.json", ("c.in", "A", False, "", "2026-03-01", 5)) == {"a.in": "B", "b.in": "X", "c.in": "A"}
    assert add("4.json", ("a.in", "X", False, "", "2026-03-01", 6)) == {"a.in": "X", "b.in": "X", "c.in": "A"}
    assert len(reviews.versions(spark, table)) == reviews.KEPT


def test_elements_stay_linear_and_pages_without_tags_have_a_row(spark):
    import time

    from leadforge.sources.html import elements, html_elements

    began = time.perf_counter()
    links = elements("<p>" + "".join(f"<a href=/{i}>x</a> words and more words " for i in range(8000)) + "in 2019</p>")
    deep = elements("<div>" * 20_000 + "<a href=/>z" + "</i>" * 20_000)
    assert time.perf_counter() - began < 5
    assert {r[4] for r in links if r[1] == "a"} == {"2019"} and sum(len(r[3]) for r in links) < 100_000
    assert len(deep) == 20_001 and sum(len(r[5]) for r in deep) == 0
    nested = elements("<nav><a href=/1>one<a href=/2>two</a></nav><footer><p><a href=/3>three</a></p></footer>")
    assert [(r[3], r[5]) for r in nested if r[1] == "a"] == [("one", ["nav"]), ("two", ["nav"]), ("three", ["footer"])]
    got = html_elements(spark.createDataFrame([(1, "just text"), (2, None), (None, "<p>x")], "k bigint, h string"), "k", "h").collect()
    assert sorted((x["k"] or 0, x["tag"], x["text"]) for x in got) == [(0, "p", ""), (1, "", "just text")]
