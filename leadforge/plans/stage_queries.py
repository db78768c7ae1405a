"""Registered queries of provider rows, structured data and stage columns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadforge.operators import stages
from leadforge.plans.views import duck, view
from leadforge.sources import providers
from leadforge.sources.html import html_elements
from leadforge.sources.structured import structured

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


_PLACES = """SELECT c_custkey AS k, '{{"id":"' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END || '","displayName":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '{{"text":"' || c_name || '"}}' END ||
',"rating":' || CASE WHEN c_custkey % 3 = 0 THEN '"high"' WHEN c_custkey % 3 = 1 THEN '4.5' ELSE 'null' END || ',"userRatingCount":' || CAST(c_nationkey AS STRING) || ',"location":{{"latitude":11.5}},"websiteUri":"http://a/' || c_name || '"}}' AS answer FROM {customer}"""


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS provider_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 1 THEN 4.5::DOUBLE END AS rating, c_nationkey::BIGINT AS review_count, 'http://a/' || c_name AS website, 11.5::DOUBLE AS lat, NULL::DOUBLE AS lng FROM customer")
def provider_rows(spark, sf_dir):
    return view(spark, sf_dir, _PLACES).select("k", providers.listing(F.col("answer")).alias("l")).select("k", *(f"l.{c}" for c in ("provider_id", "name", "rating", "review_count", "website", "lat", "lng")))


_LD = """SELECT p_partkey AS k, '<script type="application/ld+json">' || CASE p_partkey % 4 WHEN 0 THEN '{{"@graph":[{{"@type":"Shop","address":{{"@type":"PostalAddress","streetAddress":"' || p_name || '","postalCode":"641' || CAST(p_size AS STRING) || '"}}}}]}}'
WHEN 1 THEN '{{"openingHours":["Mo ' || CAST(p_size AS STRING) || '","Tu"]}}' WHEN 2 THEN '{{broken' ELSE '{{"a":1}}' END || '</script>' AS html FROM {part}"""


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_name || ', 641' || p_size END AS address, CASE WHEN p_partkey % 4 = 1 THEN 'Mo ' || p_size || ', Tu' ELSE '' END AS hours FROM part")
def structured_data(spark, sf_dir):
    found = structured(html_elements(view(spark, sf_dir, _LD), "k", "html"), "k")
    return found.select("k", "address", F.array_join("hours", "|").alias("hours"))


@query(r"""SELECT page_id, regexp_matches(substr(html, 1, 8192), '(?i)<meta[^>]+name=["'']?viewport') AS viewport, CASE WHEN regexp_matches(substr(html, 1, 8192), '(?i)<meta[^>]+name=["'']?viewport') THEN 'responsive' ELSE 'missing - legacy layout' END AS note,
nullif(regexp_extract(substr(html, 1, 8192), '(?i)<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)', 1), '') AS generator, CASE WHEN page_id % 3 = 0 THEN url ELSE html END AS page FROM pages""")
def page_head(spark, sf_dir):
    p = view(spark, sf_dir, "SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS rendered FROM {pages}")
    seen = stages.has_viewport(F.col("html"))
    return p.select("page_id", seen.alias("viewport"), stages.viewport_note(seen).alias("note"), stages.head_generator(F.col("html")).alias("generator"), stages.page_text(F.col("rendered"), F.col("html")).alias("page"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS run, CASE WHEN event_id % 4 = 0 THEN 'r0' ELSE event_type END AS effective, 'c' || event_id || ' b a ' || event_type AS chain FROM events")
def run_ids(spark, sf_dir):
    e = view(spark, sf_dir, "SELECT event_id, ts, event_type, CASE WHEN event_id % 4 = 0 THEN 'r0' WHEN event_id % 4 = 1 THEN '' END AS own FROM {events}")
    hops = F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("c"), F.col("event_id").cast("string")))
    return e.select("event_id", stages.run_id(F.col("ts")).alias("run"), stages.effective_run(F.col("own"), F.col("event_type")).alias("effective"), F.array_join(stages.redirect_chain(hops, F.col("event_type")), " ").alias("chain"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice + 0.5)::BIGINT AS lcp_ms, floor(l_discount * l_quantity / 7 * 1000 + 0.5) / 1000 AS cls,
format('{:.1f}', floor(l_extendedprice * 100 / 1048576 * 10 + 0.5) / 10) AS mb, format('{:.1f}', floor(l_extendedprice * 100 / 1024 * 10 + 0.5) / 10) AS kb FROM lineitem""")
def capture_numbers(spark, sf_dir):
    rows = view(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount * l_quantity / 7 AS cls FROM {lineitem}")
    v, size = stages.vitals(F.col("l_extendedprice"), F.col("cls")), F.col("l_extendedprice") * 100
    return rows.select("l_orderkey", "l_linenumber", v["lcp_ms"].alias("lcp_ms"), v["cls"].alias("cls"), stages.size_label(size).alias("mb"), stages.size_label(size, 1024).alias("kb"))


@query("""SELECT p_partkey, contains(p_name || CASE WHEN p_size % 5 = 0 THEN '/cookie-consent.js' ELSE '/app.js' END, 'cookie-consent') AS blocked, p_size % 4 <> 0 AS accepts,
CASE p_size % 3 WHEN 0 THEN '+91 98765 ' || (10000 + p_size) WHEN 1 THEN '+91 422 24' || p_size ELSE '+91 1' || p_size END AS phone FROM part""")
def capture_filters(spark, sf_dir):
    p = view(spark, sf_dir, "SELECT p_partkey, p_size, p_name || CASE WHEN p_size % 5 = 0 THEN '/cookie-consent.js' ELSE '/app.js' END AS script, CASE WHEN p_size % 4 = 0 THEN 'Manage cookies' ELSE 'Accept all' END AS label, CASE p_size % 3 WHEN 0 THEN '98765' || CAST(10000 + p_size AS STRING) WHEN 1 THEN '42224' || CAST(p_size AS STRING) ELSE '1' || CAST(p_size AS STRING) END AS n FROM {part}")
    return p.select("p_partkey", stages.is_consent_script(F.col("script")).alias("blocked"), stages.accepts(F.col("label")).alias("accepts"), stages.shown_phone(F.col("n")).alias("phone"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A')
SELECT o_orderkey AS k, 'shot' || coalesce((SELECT min(n) FROM f WHERE f.k = o_orderkey AND n IN (2, 3, 5)), 2) AS file FROM orders""")
def shot_files(spark, sf_dir):
    wanted = view(spark, sf_dir, "SELECT o_orderkey AS k, 'shot' || CAST(n AS STRING) AS file, n AS place FROM {orders} LATERAL VIEW explode(array(2, 3, 5)) t AS n")
    files = view(spark, sf_dir, "SELECT l_orderkey AS k, 'shot' || CAST(l_linenumber AS STRING) AS file FROM {lineitem} WHERE l_returnflag = 'A'")
    return stages.first_existing(wanted, files, "k")


@query("SELECT o_orderpriority AS vertical, min(o_orderkey) AS sample FROM orders GROUP BY 1")
def vertical_sample(spark, sf_dir):
    rows = view(spark, sf_dir, "SELECT o_orderpriority AS vertical, o_orderkey AS sample FROM {orders}")
    return stages.one_of_each(rows, "vertical", "sample")


@query("""WITH b AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN 'portal' END AS skip_reason, CASE WHEN o_custkey % 3 = 0 THEN 'skip' ELSE 'audit' END AS verdict, CASE WHEN o_custkey % 2 = 0 THEN 'parked' END AS reason FROM orders)
SELECT reason, count(*) AS n FROM (SELECT skip_reason AS reason FROM b WHERE skip_reason IS NOT NULL UNION ALL SELECT coalesce(reason, 'unknown') FROM b WHERE verdict = 'skip') GROUP BY reason""")
def skip_reasons(spark, sf_dir):
    return stages.skip_reasons(view(spark, sf_dir, "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'portal' END AS skip_reason, CASE WHEN o_custkey % 3 = 0 THEN 'skip' ELSE 'audit' END AS verdict, CASE WHEN o_custkey % 2 = 0 THEN 'parked' END AS reason FROM {orders}"))


@query("""WITH p AS (SELECT l_suppkey AS site, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'head ' || l_partkey END AS head, CAST(l_quantity AS BIGINT) AS price FROM lineitem)
SELECT site, pos, CAST(price AS VARCHAR) AS price, label FROM (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY site ORDER BY pos, head IS NULL, head ROWS UNBOUNDED PRECEDING) AS label FROM p) WHERE head IS NULL""")
def price_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "SELECT l_suppkey AS site, l_orderkey * 10 + l_linenumber AS pos, l_returnflag = 'R' AS heading, 'head ' || CAST(l_partkey AS STRING) AS text, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS price FROM {lineitem}")
    return stages.nearest_label(rows.where("NOT heading"), rows.where("heading"), "site")


@query("""SELECT o_custkey AS page, min_by('d' || o_orderkey % 13 || '.in', o_orderkey) AS domain FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0 AND o_orderkey % 13 <> o_custkey % 13 GROUP BY o_custkey""")
def credit_domains(spark, sf_dir):
    links = view(spark, sf_dir, "SELECT o_custkey AS page, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 1 THEN 'footer' ELSE 'main' END AS region, CASE WHEN o_orderkey % 3 <> 0 THEN 'external' ELSE 'social' END AS kind, 'd' || CAST(o_orderkey % 13 AS STRING) || '.in' AS domain, 'd' || CAST(o_custkey % 13 AS STRING) || '.in' AS own_domain FROM {orders}")
    return stages.credit_domains(links, "page")
