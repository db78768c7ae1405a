"""Registered queries of saved sites: contacts, links, credits and signals of whole pages, agencies, and the stages' tables.

A page is made for every customer, its parts chosen by the customer's number, so that a site has any mix of what the operators look for, or no page
at all. The SQL does not read the pages: it says from the same numbers what is to be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadforge.functions import urls
from leadforge.operators import assembly, links, report, signals, stages
from leadforge.plans.views import duck, view
from leadforge.sources import listings, sinks
from leadforge.sources.html import html_elements
from leadforge.sources.shared import new_folder

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


YEAR, TODAY = 2026, "2026-09-18"
#: Parts of a page: what the number is taken modulo, and the part for each rest.
HEAD = (
    (4, {0: '<script src="/js/jquery-1.12.4.min.js"></script>', 1: '<script src="/js/jquery.js"></script>', 2: '<script>var q = 1; jQuery.fn.jquery = "2.2.4";</script>'}),
    (5, {0: '<link href="/css/bootstrap-3.3.7.css">', 1: '<script src="/js/bootstrap.4.6.0.js"></script>', 2: "<style>/* Bootstrap v5.1.3 */</style>"}),
    (3, {0: '<script src="/revslider/revslider-5.2.1.js"></script>', 1: '<link href="/css/swiper-bundle-8.0.css">'}),
    (6, {0: '<meta name="generator" content="Joomla! 3">', 1: '<link href="/wp-content/themes/Avada/style.css?ver=5.8.1">', 2: '<link href="/wp-content/themes/own@n/style.css">',
         3: '<script src="/_next/static/app.js"></script>', 4: '<script src="https://static.parts.com/wixstatic/x.js"></script>'}),
    (2, {0: '<meta name="viewport" content="width=device-width">'}),
)
NAV = '<nav><a href="/about@n#team">About</a><a href="/about@n">Again</a><a href="javascript:void(0)">x</a><a href=" ">y</a></nav>'
BODY = (
    (3, {0: '<a href="tel:+91 98@d">Call</a>'}),
    (4, {1: '<a href="mailto:Info@n@at@site@n.in?subject=x">Mail</a>'}),
    (10, {2: '<a class="float-btn" href="https://wa.me/9196@d">Chat</a>', 7: '<a href="https://wa.me/9196@d">Chat</a>'}),
    (6, {0: '<a href="https://instagram.com/shop.@n">i</a>', 1: '<a href="https://instagram.com/p/abc@n">i</a>', 2: '<a href="https://www.instagram.com/p.studio@n/">i</a>'}),
    (7, {0: '<a href="https://facebook.com/sharer/x">f</a>', 1: '<a href="https://facebook.com/dialog.@n">f</a>', 2: '<a href="https://www.facebook.com/page@n?x=1">f</a>'}),
    (4, {0: "<p>Phone 97@d today</p>"}),
    (6, {0: "<p>Again 098@d now</p>"}),
    (5, {0: "<p>Office 0422-2@six in town</p>", 1: "<p>Office +91 422 @six in town</p>"}),
    (9, {3: "<p>write to hello@n@at@site@n.in now</p>", 4: "<p>or x@n@at@example.com now</p>", 5: "<p>see pic@at@cdn@n.png now</p>", 6: "<p>not noreply@at@site@n.in now</p>", 7: "<p>or INFO@n@at@site@n.in now</p>"}),
    (10, {0: "".join(f'<a href="/p{i}">p</a>' for i in range(45))}),
    (3, {1: '<p>Posted 2021 <a href="/blog/@n">Blog</a></p>', 2: '<p><a href="/news">News</a></p>'}),
    (7, {0: '<img src="http://a.in/x.png">'}),
    (8, {0: '<img src=""><img>'}),
    (9, {0: '<video autoplay src="/v.mp4"></video>'}),
    (4, {0: '<form action="mailto:x@at@z.in"></form>', 1: '<form action="/send@n" class="wpcf7"></form>', 2: '<form method="post"></form>'}),
    (1, {0: '<a href="https://partner@n.com/?utm_source=a">P</a>'}),
    (5, {1: '<div class="site-footer">Website by  Old   Mill!<br></div>'}),
)
FOOT = (
    (4, {0: "no mark<br>", 1: "&copy; 2009 - 20@y<br>", 2: "Copyright 2011<br>", 3: "plain<br>"}),
    (5, {0: '<p>Designed by Pixel Studio.<br></p><a href="https://pixel@r.com/">site</a>'}),
    (1, {0: '<a href="/terms">Terms</a>'}),
)


def _part(rests: dict[int, str], of: int) -> str:
    quoted = " ".join(f"WHEN {r} THEN '{text}'" for r, text in rests.items())
    return f"CASE c_custkey % {of} {quoted} ELSE '' END"


def _page() -> str:
    pieces = ["'<html><head>'", *(_part(rests, of) for of, rests in HEAD), f"'</head><body>{NAV}'", *(_part(rests, of) for of, rests in BODY), "'<footer>'", *(_part(rests, of) for of, rests in FOOT), "'</footer></body></html>'"]
    whole = f"concat({', '.join(pieces)})"
    for mark, value in (("@n", "CAST(c_custkey AS STRING)"), ("@d", _D), ("@six", f"substr({_D}, 3)"), ("@y", "lpad(CAST(c_custkey % 20 AS STRING), 2, '0')"), ("@r", "CAST(c_custkey % 3 AS STRING)"), ("@at@", "'@'")):
        whole = f"replace({whole}, '{mark}', {value})"
    return whole


#: The customer's number in eight digits.
_D = "lpad(CAST(c_custkey AS STRING), 8, '0')"
_SITES = f"""SELECT c_custkey AS k, concat('https://www.site', c_custkey, '.in/home') AS url,
  CASE WHEN c_custkey % 97 = 96 THEN NULL WHEN c_custkey % 89 = 88 THEN '' ELSE {_page()} END AS html FROM {{customer}}"""
#: The sites with a page, for the SQL.
_SHOWN = f"SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS n, {_D} AS d FROM customer WHERE c_custkey % 97 <> 96 AND c_custkey % 89 <> 88"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _SITES, "c_custkey")


@query(f"""WITH s AS ({_SHOWN}), c AS (
SELECT k, 'phone' AS kind, '98' || d AS norm, 0 AS stage FROM s WHERE k % 3 = 0
UNION ALL SELECT k, 'phone', '97' || d, 1 FROM s WHERE k % 4 = 0
UNION ALL SELECT k, 'phone', CASE k % 5 WHEN 0 THEN '4222' ELSE '422' END || substr(d, 3), 2 FROM s WHERE k % 5 < 2
UNION ALL SELECT k, 'email', 'info' || n || '@site' || n || '.in', 0 FROM s WHERE k % 4 = 1
UNION ALL SELECT k, 'email', CASE k % 9 WHEN 3 THEN 'hello' ELSE 'info' END || n || '@site' || n || '.in', 1 FROM s WHERE k % 9 IN (3, 7)
UNION ALL SELECT k, 'whatsapp', '9196' || d, 0 FROM s WHERE k % 5 = 2
UNION ALL SELECT k, 'instagram', CASE k % 6 WHEN 0 THEN 'shop.' ELSE 'p.studio' END || n, 0 FROM s WHERE k % 6 IN (0, 2)
UNION ALL SELECT k, 'facebook', CASE k % 7 WHEN 1 THEN 'dialog.' ELSE 'page' END || n, 0 FROM s WHERE k % 7 IN (1, 2))
SELECT k, kind, norm, min(stage) AS stage FROM c GROUP BY k, kind, norm""")
def site_contacts(spark, sf_dir):
    return links.contacts(html_elements(sites(spark, sf_dir), "k", "html", links.CONTACT_TAGS), "k").select("k", "kind", "norm", "stage")


@query(f"""WITH s AS ({_SHOWN}), l AS (SELECT k, 2 + (k % 3 > 0)::INTEGER + CASE WHEN k % 10 = 0 THEN 45 ELSE 0 END AS internal, 1 + (k % 5 = 0)::INTEGER AS external,
(k % 5 = 2)::INTEGER + (k % 6 < 3)::INTEGER + (k % 7 < 3)::INTEGER AS socials, (k % 3 = 0)::INTEGER + (k % 4 = 1)::INTEGER AS others FROM s)
SELECT k, (internal + external + socials + others)::BIGINT AS total, internal::BIGINT AS internal, external::BIGINT AS external, 1::BIGINT AS nav, (1 + (k % 5 = 0)::INTEGER)::BIGINT AS footer, socials::BIGINT AS socials,
least(internal, 40)::BIGINT AS asked, (k % 13 = 0 AND k % 10 <> 0)::INTEGER::BIGINT AS dead FROM l""")
def site_links(spark, sf_dir):
    """Counts of links, of those whose status is asked, and of the dead ones among these: some sites have lost their terms, and an address may have several statuses."""
    pages = sites(spark, sf_dir)
    folder = new_folder(spark, "links")  # pages are parsed once for the three counts
    links.links(html_elements(pages, "k", "html", links.LINK_TAGS), pages, "k").write.parquet(folder)
    found = spark.read.parquet(folder)
    gone = pages.where("k % 13 = 0").select(F.concat(F.lit("https://www.site"), F.col("k").cast("string"), F.lit(".in/terms")).alias("href"), F.explode(F.array(F.lit(200), F.lit(404))).alias("status"))
    asked = links.probe_queue(found, "k").groupBy("k").agg(F.count(F.lit(1)).alias("asked"))
    dead = assembly.dead_links(found, gone, "k").select("k", "dead")
    # a row of each for every site: joined by a shuffle, since their files look small enough for the driver long after they are not
    return links.link_counts(found, "k").join(asked.hint("merge"), "k").join(dead.hint("merge"), "k").select("k", "total", "internal", "external", "nav", "footer", "socials", "asked", "dead")


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, domain, name, credit_domain, raw_text): who built a site, by its footer."""
    pages, folder = sites(spark, sf_dir), new_folder(spark, "elements")
    links.credit_elements(html_elements(pages, "k", "html")).write.parquet(folder)  # pages are parsed once for links and lines
    elements = spark.read.parquet(folder)
    found = links.links(elements, pages, "k").join(pages.select("k", urls.registrable(F.col("url")).alias("own_domain")).hint("merge"), "k")
    domains = stages.credit_domains(found.withColumn("domain", urls.registrable(F.col("href"))), "k").withColumnRenamed("domain", "credit_domain")
    return links.agency_credits(elements, "k").join(domains.hint("merge"), "k", "left").select("k", F.concat(F.lit("site"), F.col("k").cast("string"), F.lit(".in")).alias("domain"), "name", "credit_domain", "raw_text")


_CREDITS = f"""SELECT k, 'site' || n || '.in' AS domain, CASE k % 5 WHEN 0 THEN 'Pixel Studio' ELSE 'Old Mill' END AS name, CASE k % 5 WHEN 0 THEN 'pixel' || k % 3 || '.com' END AS credit_domain,
CASE k % 5 WHEN 0 THEN 'Designed by Pixel Studio.' ELSE 'Website by  Old   Mill!' END AS raw_text FROM ({_SHOWN}) WHERE k % 5 < 2"""


@query(_CREDITS)
def site_credits(spark, sf_dir):
    return credits(spark, sf_dir)


@query(f"""WITH c AS ({_CREDITS})
SELECT coalesce(credit_domain, 'old mill media') AS agency, CASE WHEN any_value(credit_domain) IS NULL THEN 'Old Mill Media' ELSE 'Pixel Studio' END AS name, any_value(credit_domain) AS domain, any_value(raw_text) AS raw_text,
count(*) AS built_in_run, count(DISTINCT domain) AS clients FROM c GROUP BY 1""")
def agency_directory(spark, sf_dir):
    """Agencies by domain or resolved name, and how many sites are their clients."""
    folder = new_folder(spark, "credits")
    credits(spark, sf_dir).write.parquet(folder)  # found once for the agencies and their clients
    rows = spark.read.parquet(folder).select(F.col("k").alias("lead_no"), "domain", F.col("name").alias("credit_name"), "credit_domain", "raw_text")
    agencies, clients = report.agency_directory(rows, [("old mill", "Old Mill Media")])
    return agencies.join(clients.groupBy("agency").agg(F.count(F.lit(1)).alias("clients")), "agency")


_ONE = "printf('%.1f', floor(({}) * 10 + 0.5e0) / 10)"


@query(f"""WITH s AS (SELECT k, n, CASE WHEN k % 4 <> 0 THEN 2005 + k % 22 END AS born, CASE k % 4 WHEN 1 THEN 2000 + k % 20 WHEN 2 THEN 2011 END AS made,
k % 5 <> 1 AS ok, k % 7 = 0 AS old, k % 6 <> 5 AS ends_safe FROM ({_SHOWN}))
SELECT k, coalesce(CAST(made AS VARCHAR), 'none') AS copyright, CASE k % 4 WHEN 0 THEN '1.12.4' WHEN 1 THEN 'present' WHEN 2 THEN '2.2.4' ELSE 'none' END AS jquery,
CASE k % 5 WHEN 0 THEN '3.3.7' WHEN 1 THEN '4.6.0' WHEN 2 THEN '5.1.3' ELSE 'none' END AS bootstrap, CASE k % 3 WHEN 0 THEN 'revslider 5.2.1' WHEN 1 THEN 'swiper 8.0' ELSE 'none' END AS slider,
CASE k % 6 WHEN 0 THEN 'Joomla! 3' WHEN 1 THEN 'WordPress 5.8.1' WHEN 2 THEN 'WordPress' WHEN 3 THEN 'Next.js' WHEN 4 THEN 'Wix' ELSE 'static html' END AS generator,
CASE k % 6 WHEN 1 THEN 'Avada (ThemeForest)' WHEN 2 THEN 'own' || n ELSE 'none' END AS theme,
CASE WHEN born IS NULL THEN 'none' WHEN born >= {YEAR} THEN '0 mo' ELSE ({YEAR} - born) || ' yr' END AS "domainAge", coalesce(CAST(born AS VARCHAR), 'none') AS wayback,
CASE WHEN k % 11 = 0 THEN 'given' WHEN born IS NULL THEN 'n/a' WHEN made > born + 1 THEN CAST(made AS VARCHAR) ELSE 'never' END AS redesigned,
CASE WHEN k % 5 = 0 THEN 'present' WHEN k % 5 = 1 THEN 'missing' WHEN k % 2 = 0 THEN 'present' ELSE 'missing' END AS viewport,
CASE WHEN k % 3 = 2 THEN '+' || (k % 500 + 1) || 'px' ELSE '0px' END AS overflow, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 50 END || ' under 44px' AS "tapTargets",
CASE WHEN k % 5 = 0 THEN 'none' ELSE {_ONE.format('(k % 9000 + 100)::DOUBLE / 1000')} || 's' END AS lcp, CASE WHEN k % 6 = 0 THEN 'none' ELSE {_ONE.format('(k * 7919 + 1)::DOUBLE / 1048576')} || ' MB' END AS "pageWeight",
CASE WHEN k % 5 = 0 THEN {_ONE.format('(k * 4096 + 1000000)::DOUBLE / 1048576')} || ' MB webm' || CASE WHEN k % 9 = 0 THEN ', autoplay' ELSE '' END WHEN k % 9 = 0 THEN 'present' ELSE 'none' END AS "heroVideo",
CASE WHEN NOT ok THEN 'none - http only' WHEN old THEN 'expired 2024-03' WHEN NOT ends_safe THEN 'none - http only' ELSE 'ok' END AS https,
CASE WHEN ok AND ends_safe AND k % 7 = 0 THEN '1 assets' ELSE 'none' END AS "mixedContent", CASE k % 8 WHEN 0 THEN '2' WHEN 1 THEN '1' ELSE '0' END AS "brokenImages",
CASE k % 10 WHEN 2 THEN 'float button' WHEN 7 THEN 'present' ELSE 'none' END AS whatsapp,
CASE WHEN k % 8 = 1 THEN 'broken' WHEN k % 4 = 0 THEN 'mailto: only' WHEN k % 4 = 1 THEN 'contact form 7' WHEN k % 4 = 2 THEN 'contact form' ELSE 'none' END AS "quoteForm",
CASE k % 3 WHEN 1 THEN 'last post 2021' WHEN 2 THEN 'present' ELSE 'none' END AS blog FROM s""")
def site_signals(spark, sf_dir):
    """All signals of a site: those of its page with what its capture measured."""
    pages, k = sites(spark, sf_dir), F.col("k")
    video = lambda url, size: F.struct(F.lit(url).alias("url"), size.cast("bigint").alias("bytes"))
    measured = pages.select(
        "k", F.when(k % 3 == 1, 0).when(k % 3 == 2, (k % 500 + 1).cast("int")).alias("overflow_px"), F.when(k % 4 != 0, k % 50).alias("tap_targets"), F.when(k % 5 != 0, (k % 9000 + 100).cast("double")).alias("lcp_ms"),
        F.when(k % 6 == 0, 0).otherwise(k * 7919 + 1).alias("transfer_bytes"), F.when(k % 5 == 0, F.array(video("w.mp4", F.lit(10)), video("v.webm", k * 4096 + 1_000_000))).alias("videos"),
        F.when(k % 8 == 1, F.array(F.concat(F.lit("/send"), k.cast("string")), F.lit("https://a.in/x.JPG"), F.lit("/track"))).alias("broken"), F.when(k % 4 != 0, (2005 + k % 22).cast("string")).alias("wayback_first"),
        (k % 5 != 1).alias("https_ok"), F.when(k % 7 == 0, F.lit("2024-03-09")).when(k % 7 == 1, "2030-01-01").cast("date").alias("cert_expires"), F.when(k % 6 == 5, "http://x.in/").otherwise("https://x.in/").alias("final_url"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("viewport_meta"), F.when(k % 11 == 0, "given").alias("redesigned_given"),
    )
    page = signals.page_signals(html_elements(pages, "k", "html"), "k")
    out = signals.with_capture(page.join(measured.hint("merge"), "k"), YEAR, TODAY, market=[("avada", "ThemeForest")])
    return out.select("k", "copyright", "jquery", "bootstrap", "slider", "generator", "theme", "domainAge", "wayback", "redesigned", "viewport", "overflow", "tapTargets", "lcp", "pageWeight", "heroVideo", "https", "mixedContent", "brokenImages", "whatsapp", "quoteForm", "blog")


_FOUND = """SELECT c_custkey AS k, c_mktsegment AS vertical, c_custkey % 6 AS tile, concat('word ', c_custkey % 4) AS keyword, CASE WHEN c_custkey % 11 <> 0 THEN concat('site', c_custkey, '.in') END AS domain,
  CASE WHEN c_custkey % 11 = 0 THEN 'aggregator-profile-only' END AS skip_reason, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 3 END AS review_count FROM {customer}"""


@query(f"""WITH f AS ({_FOUND}), d AS (SELECT *, CASE WHEN vertical = 'BUILDING' THEN 'run-2' ELSE 'run-1' END AS run FROM f WHERE vertical <> 'BUILDING' OR k % 2 = 0)
SELECT vertical, run, count(DISTINCT tile) AS tiles, count(DISTINCT keyword) AS keywords, count(*) AS raw_results, count(domain) AS with_domain, count(*) FILTER (skip_reason IS NOT NULL) AS greenfield, count(*) AS businesses,
count(*) FILTER (domain IS NOT NULL AND k % 3 <> 0) AS audited, count(*) FILTER (domain IS NOT NULL AND k % 3 <> 0 AND review_count IS NOT NULL) AS scored, count(*) FILTER (domain IS NOT NULL AND k % 3 <> 0 AND review_count IS NULL) AS failed
FROM d GROUP BY vertical, run""")
def stage_documents(spark, sf_dir):
    """Found, qualified and scored rows written stage by stage; a second run finds one vertical anew, and rows that cannot be scored are dead letters."""
    folder, found = new_folder(spark, "documents"), view(spark, sf_dir, _FOUND)
    again = found.where("vertical = 'BUILDING' AND k % 2 = 0")
    for run, rows in (("run-1", found), ("run-2", again)):
        sinks.write_document(rows, sinks.document_head(rows, run, "recorded", "2026-01-01"), f"{folder}/found")
    verdict = F.when(F.col("domain").isNull() | (F.col("k") % 3 == 0), "skip").otherwise("audit")
    sinks.write_stage(listings.stage_rows(spark, f"{folder}/found/rows").withColumn("verdict", verdict), f"{folder}/qualified")
    qualified = listings.stage_rows(spark, f"{folder}/qualified")
    good, bad = sinks.split_errors(qualified.where("verdict = 'audit'"), F.when(F.col("review_count").isNull(), F.lit("no reviews")), "score")
    sinks.write_stage(good, f"{folder}/scores")
    bad.write.parquet(f"{folder}/errors")
    count = lambda df, name: df.groupBy("vertical").agg(F.count(F.lit(1)).alias(name))
    tally = qualified.groupBy("vertical").agg(F.count(F.lit(1)).alias("businesses"), F.count_if(F.col("verdict") == "audit").alias("audited"))
    failed = count(spark.read.parquet(f"{folder}/errors").join(qualified.select("domain", "vertical"), "domain"), "failed")
    out = listings.stage_rows(spark, f"{folder}/found/head").join(tally, "vertical").join(count(listings.stage_rows(spark, f"{folder}/scores"), "scored"), "vertical", "left").join(failed, "vertical", "left")
    return out.select("vertical", "run", "tiles", "keywords", "raw_results", "with_domain", "greenfield", "businesses", "audited", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("scored", "failed")))


@query("""SELECT c_custkey AS k, c_name AS name, 'run' AS source, false AS synthetic FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name, 'made up', true FROM customer WHERE c_custkey % 2 = 1""")
def boot_sources(spark, sf_dir):
    """Leads of the first source that can be read: a service's, a run's, or the made-up ones; one reader finds a run, another only the last."""
    folder, rows = new_folder(spark, "boot"), view(spark, sf_dir, "SELECT c_custkey AS k, c_name AS name FROM {customer}")
    rows.where("k % 2 = 0").write.parquet(f"{folder}/run")
    rows.where("k % 2 = 1").write.parquet(f"{folder}/made")
    run = listings.first_of(spark, [("service", f"{folder}/service"), ("run", f"{folder}/run"), ("made up", f"{folder}/made")])
    return run.unionByName(listings.first_of(spark, [("service", f"{folder}/service"), ("run", f"{folder}/none"), ("made up", f"{folder}/made")]))
