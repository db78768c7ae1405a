"""Registered queries of sources, streams and keyed tables: what they keep on the way is written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadforge.functions import suffixes, urls
from leadforge.operators import assembly, classify, config, phrasebook, schedule
from leadforge.plans.views import duck, view
from leadforge.sources import document, html_table, outputs, recorded, runlog
from leadforge.sources.keyed import KeyedTable
from leadforge.sources.lead_store import LeadStore
from leadforge.sources.shared import new_folder
from leadforge.streaming import marks, resume

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


#: Customers as places that searches found: the part with their number gives the keyword; some lack fields.
_PLACES = """
SELECT c_mktsegment AS vertical, CAST(c_custkey % 6 AS INT) AS tile, lower(p_type) AS keyword, 'p' || CAST(c_custkey AS STRING) AS provider_id,
  CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS rating, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 3 END AS review_count, c_custkey AS k
FROM {customer} JOIN {part} ON p_partkey = c_custkey
"""


@query(f"WITH p AS ({_PLACES}) SELECT vertical, tile, keyword, provider_id, coalesce(name, '') AS name, rating, review_count::BIGINT AS review_count FROM p WHERE k % 50 <> 0 AND vertical IN ('BUILDING', 'MACHINERY') AND tile <> 5")
def recorded_source(spark, sf_dir):
    places = view(spark, sf_dir, _PLACES)
    fields = F.struct(F.col("provider_id").alias("id"), F.struct(F.col("name").alias("text")).alias("displayName"), "rating", F.col("review_count").alias("userRatingCount"))
    path = new_folder(spark, "answers")
    recorded.write_answers(places.withColumn("place", F.when(F.col("k") % 50 == 0, F.lit("no answer")).otherwise(F.to_json(fields))), path)
    keywords = [r[0] for r in view(spark, sf_dir, "SELECT DISTINCT lower(p_type) AS t FROM {part}").collect()]  # a configuration's words
    # one vertical and one keyword were never searched
    found = recorded.read_source(spark, "recorded", path=path, verticals="BUILDING,MACHINERY,HOUSEHOLD,GARDENS", keywords=",".join([*keywords, "unheard"]), tiles="5")
    out = recorded.listings(found.where(F.col("vertical").isin("BUILDING", "MACHINERY", "GARDENS")))
    return out.select("vertical", "tile", "keyword", "provider_id", "name", "rating", "review_count")


#: Events as marks that people set: some without a tier, in files that overlap in time, so that most files bring late marks.
_MARKS = """
SELECT 'site' || CAST(user_id AS STRING) || '.in' AS domain, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'X' WHEN 'view' THEN 'B' END AS human_tier, event_id % 3 = 0 AS pitch,
  CASE WHEN event_id % 5 = 0 THEN 'note ' || event_type END AS note, substr(CAST(ts AS STRING), 1, 13) AS reviewed_at, event_id AS seq FROM {events}
"""


@query(f"WITH m AS ({_MARKS}) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY reviewed_at DESC, seq DESC) AS r FROM m) WHERE r = 1")
def review_marks(spark, sf_dir):
    folder = new_folder(spark, "marks")
    view(spark, sf_dir, _MARKS).withColumn("part", F.col("seq") % 3).repartition("part").write.partitionBy("part").json(f"{folder}/in")
    marks.keep_marks(marks.mark_files(spark, f"{folder}/in/part=*", 1), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return marks.current(spark, f"{folder}/table")


_SCORES = "SELECT o_custkey AS domain, o_orderkey AS run, o_totalprice AS price, o_orderstatus AS status, o_orderkey % 3 AS step FROM {orders}"


@query(f"""WITH o AS ({_SCORES}),
a AS (SELECT domain, max(run) AS run, arg_max(price, run) AS price, arg_max(status, run) AS status FROM o WHERE step = 0 GROUP BY domain),
b AS (SELECT domain, min(run) AS run, arg_min(price, run) AS price, arg_min(status, run) AS status FROM o WHERE step = 1 GROUP BY domain),
c AS (SELECT domain, max(run) AS run, arg_max(status, run) AS status FROM o WHERE step = 2 GROUP BY domain)
SELECT domain, CASE WHEN a.domain IS NOT NULL THEN a.price ELSE b.price END AS price, coalesce(c.status, a.status, b.status) AS status, coalesce(c.run, a.run, b.run) AS run
FROM a FULL JOIN b USING (domain) FULL JOIN c USING (domain)""")
def keyed_upserts(spark, sf_dir):
    steps = view(spark, sf_dir, _SCORES)
    table = KeyedTable(spark, new_folder(spark, "scores"), "domain bigint, run bigint, price double, status string", ["domain"], buckets=8)
    table.upsert(steps.where("step = 0").drop("step"), "replace", ["run"])
    table.upsert(steps.where("step = 1").drop("step"), "ignore", ["run"])
    table.upsert(steps.where("step = 2").drop("step", "price"), "update", ["run"])
    table.compact(2)
    return table.read().select("domain", "price", "status", "run")


#: Businesses as qualification finds them: some have a verdict from before, which must stay.
_TODO = """
SELECT c_custkey AS place, 'https://www.shop' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN '.co.in/' ELSE '.com/' END AS website, CASE WHEN c_custkey % 9 = 0 THEN 'kept' END AS verdict,
  CASE c_custkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 500 END AS status, c_nationkey % 2 AS part FROM {customer}
"""


@query(f"""WITH t AS ({_TODO}) SELECT place, coalesce(verdict, CASE WHEN status IS NULL OR status >= 400 THEN 'skip' ELSE 'audit' END) AS verdict,
CASE WHEN verdict IS NULL THEN CASE WHEN status IS NULL THEN 'dead-host' WHEN status >= 400 THEN 'http-error' END END AS reason,
CASE WHEN verdict IS NULL THEN regexp_replace(regexp_extract(website, '//([^/]+)', 1), '^www\\.', '') END AS domain FROM t""")
def resume_stream(spark, sf_dir):
    folder = new_folder(spark, "qualify")
    todo = view(spark, sf_dir, _TODO)

    def work(rows):
        judged = classify.verdict(F.lit(True), F.lit(None).cast("string"), F.col("status"), F.col("website"), F.col("website"), F.lit(False))
        return {"verdict": judged["verdict"], "reason": judged["reason"], "domain": urls.registrable(F.col("website"))}

    schema = "place bigint, website string, verdict string, status int"
    for part in (0, 1):  # the second run finds the files of the first done
        todo.where(F.col("part") == part).drop("part").write.mode("append").json(f"{folder}/in")
        resume.run_stage(spark, f"{folder}/in", schema, F.col("verdict").isNotNull(), work, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return resume.in_first_order(spark, f"{folder}/table", "place").select("place", "verdict", "reason", "domain")


#: Aliases are passages of documents and suppliers' numbers: many more than a chain of conditions could hold.
_ALIASES = """
SELECT row_number() OVER (ORDER BY key) - 1 AS ordinal, key, upper(key) AS value FROM (
  SELECT DISTINCT lower(substr(text, 20, 9)) AS key FROM {documents} WHERE doc_id % 5 = 0 AND length(text) >= 40 UNION SELECT lower(s_name) FROM {supplier} WHERE s_suppkey % 2 = 0
) a ORDER BY key LIMIT 10000
"""


@query(f"""WITH a AS ({_ALIASES}), t AS (SELECT 'd' || doc_id AS k, text AS raw FROM documents UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)
SELECT k, ordinal::INTEGER AS place FROM (SELECT k, min(ordinal) AS ordinal FROM t LEFT JOIN a ON contains(lower(raw), key) GROUP BY k)""")
def alias_automaton(spark, sf_dir):
    aliases = [(r["key"], r["value"]) for r in view(spark, sf_dir, _ALIASES).collect()]  # a bounded configuration
    texts = view(spark, sf_dir, "SELECT concat('d', doc_id) AS k, text AS raw FROM {documents} UNION ALL SELECT concat('s', s_suppkey), s_name FROM {supplier}")
    return texts.select("k", phrasebook.first_phrase(F.col("raw"), [k for k, _ in aliases]).alias("place"))


@query(f"WITH a AS ({_ALIASES}), m AS (SELECT s_suppkey, min_by(value, ordinal) AS value FROM supplier JOIN a ON contains(lower(s_name), key) GROUP BY s_suppkey) SELECT s_suppkey, coalesce(value, s_name) AS name FROM supplier LEFT JOIN m USING (s_suppkey)")
def alias_names(spark, sf_dir):
    aliases = [(r["key"], r["value"]) for r in view(spark, sf_dir, _ALIASES).collect()]
    raw = view(spark, sf_dir, "SELECT s_suppkey, concat(' ', s_name, '!,') AS raw FROM {supplier}")
    return phrasebook.canonical_names(raw, "raw", aliases).select("s_suppkey", "name")


#: Suffix rules: some fixed, a wildcard, and an exception to it for the hosts of every seventh page.
_RULES = """
SELECT DISTINCT rule FROM (
  SELECT '!' || regexp_extract(url, '([^./:]+[.]example[.]net)', 1) AS rule FROM {pages} WHERE page_id % 7 = 0 AND url LIKE '%.example.net%'
  UNION ALL SELECT 'com' UNION ALL SELECT 'org' UNION ALL SELECT 'net' UNION ALL SELECT 'example.com' UNION ALL SELECT '*.example.net' UNION ALL SELECT '*.ck' UNION ALL SELECT '!www.ck'
) r
"""


@query(rf"""WITH rules AS ({_RULES}), h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
c AS (SELECT page_id, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM h),
f AS (SELECT page_id, n, 0 AS ex, array_to_string(l[-n:], '.') AS rule FROM c UNION ALL SELECT page_id, n, 0, '*.' || array_to_string(l[-(n - 1):], '.') FROM c WHERE n > 1 UNION ALL SELECT page_id, n, 1, '!' || array_to_string(l[-n:], '.') FROM c),
best AS (SELECT page_id, max(ex * 100 + n) AS b FROM f JOIN rules USING (rule) GROUP BY page_id),
w AS (SELECT page_id, string_split(host, '.') AS l, coalesce(b % 100 - b // 100, 1) AS width FROM h LEFT JOIN best USING (page_id))
SELECT page_id, CASE WHEN len(l) > width THEN array_to_string(l[-(width + 1):], '.') END AS domain FROM w""")
def public_suffix(spark, sf_dir):
    hosts = view(spark, sf_dir, "SELECT page_id, url FROM {pages}").select("page_id", urls.host(F.col("url")).alias("host"))
    return suffixes.with_registrable(hosts, "host", view(spark, sf_dir, _RULES)).select("page_id", "domain")


_REQUESTS = "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 0 ELSE user_id END AS host, ts FROM {events}"


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS i FROM ({_REQUESTS})),
s AS (
  SELECT event_id, host, i, ts, ts AS start FROM q WHERE i = 1
  UNION ALL SELECT q.event_id, q.host, q.i, q.ts, greatest(q.ts, s.start + INTERVAL 5400 SECOND) FROM s JOIN q ON q.host = s.host AND q.i = s.i + 1
) SELECT event_id, host, start FROM s""")
def host_start_times(spark, sf_dir):
    return schedule.start_times(view(spark, sf_dir, _REQUESTS), "host", "ts", "event_id", 5400, 86_400).select("event_id", "host", F.col("start").cast("timestamp_ntz").alias("start"))


@query("""SELECT 'run-1' AS run_id, s AS stage, count(*) AS n_rows, count(*) FILTER (NOT e AND NOT k) AS ok, count(*) FILTER (e) AS errors, count(*) FILTER (k AND NOT e) AS skipped FROM (
SELECT c_mktsegment AS s, coalesce(c_acctbal < 0, false) AS e, c_nationkey % 3 = 0 AS k FROM customer) GROUP BY s""")
def stage_run_log(spark, sf_dir):
    folder = new_folder(spark, "stages")
    rows = view(spark, sf_dir, "SELECT * FROM {customer}")
    for stage in [r[0] for r in rows.select("c_mktsegment").distinct().collect()]:  # a stage for each of the few segments
        runlog.write_counted(rows.where(F.col("c_mktsegment") == stage), f"{folder}/{stage}", stage, "run-1", f"{folder}/log", F.col("c_acctbal") < 0, F.col("c_nationkey") % 3 == 0)
    return runlog.run_log(spark, f"{folder}/log")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<img'))::BIGINT AS images, len(regexp_extract_all(html, '<a[ >]'))::BIGINT AS anchors,
len(list_distinct(list_filter(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1), lambda h: starts_with(h, '/'))))::BIGINT AS inner_addresses FROM pages""")
def elements_in_sql(spark, sf_dir):
    html_table.register(spark)
    return view(spark, sf_dir, """
SELECT p.page_id, count_if(e.tag = 'img') AS images, count_if(e.tag = 'a') AS anchors, count(DISTINCT CASE WHEN e.tag = 'a' AND startswith(e.attrs['href'], '/') THEN e.attrs['href'] END) AS inner_addresses
FROM {pages} p, LATERAL html_elements(p.html, 'tag,attrs') e GROUP BY p.page_id""")


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT page_id, count(DISTINCT regexp_replace(href, '#.*$', '')) AS links FROM a GROUP BY page_id)
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<meta[^>]*name="viewport"') THEN 'present' ELSE 'missing' END AS viewport,
CASE WHEN regexp_matches(html, '<form') THEN 'contact form' ELSE 'none' END AS "quoteForm", coalesce(links, 0) AS links FROM pages LEFT JOIN l USING (page_id)""")
def page_outputs(spark, sf_dir):
    out = outputs.write_outputs(view(spark, sf_dir, "SELECT page_id, url, html FROM {pages}"), new_folder(spark, "outputs"))
    links = out.links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return out.signals.join(links, "page_id", "left").select("page_id", "viewport", "quoteForm", F.coalesce("links", F.lit(0)).alias("links"))


#: Two runs of a report over customers: the second scores only some of them anew and finds other names.
_RUNS = """
SELECT concat('site', c_custkey, '.in') AS domain, c_mktsegment AS vertical, concat(c_name, CASE WHEN r = 2 THEN ' Ltd' ELSE '' END) AS name, c_custkey % 5 AS review_count, r,
  concat('run-', CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE r END) AS run_id, CAST(floor(c_acctbal) AS BIGINT) + r AS score, c_custkey % 3 = 0 AS mobile, c_custkey % 4 = 0 AS secure
FROM {customer}, (SELECT 1 AS r UNION ALL SELECT 2) runs WHERE r = 1 OR c_custkey % 2 = 0
"""


@query(f"""WITH d AS ({_RUNS}), b AS (SELECT domain, arg_min(name, r) AS name FROM d GROUP BY domain),
s AS (SELECT domain, run_id, arg_max(score, r) AS score, any_value(mobile) AS mobile, any_value(secure) AS secure FROM d GROUP BY domain, run_id),
v AS (SELECT 'site' || doc_id || '.in' AS domain, CASE WHEN toxic = 1 THEN 'X' ELSE 'A' END AS human_tier, quality AS pitch FROM labels)
SELECT s.domain, name, run_id, score, CASE WHEN mobile AND secure THEN '["mobile","https"]' WHEN mobile THEN '["mobile"]' WHEN secure THEN '["https"]' ELSE '[]' END AS flaws, human_tier, pitch::INTEGER AS pitch
FROM s JOIN b USING (domain) LEFT JOIN v USING (domain)""")
def lead_store(spark, sf_dir):
    store = LeadStore(spark, new_folder(spark, "store"), buckets=4)
    rows = view(spark, sf_dir, _RUNS)
    marks = view(spark, sf_dir, "SELECT concat('site', doc_id, '.in') AS domain, CASE WHEN toxic = 1 THEN 'X' ELSE 'A' END AS human_tier, quality = 1 AS pitch, '' AS note, '2024' AS reviewed_at FROM {labels}")
    store.review(marks)
    flaws = F.array_compact(F.array(F.when(F.col("mobile"), F.lit("mobile")), F.when(F.col("secure"), F.lit("https"))))
    for r in (1, 2):
        run = rows.where(F.col("r") == r)
        store.write("businesses", run)
        store.write("scores", run.withColumn("flaws", flaws))
    scores = store.read("scores").join(store.read("businesses").select("domain", "name"), "domain")
    return scores.join(store.read("reviews"), "domain", "left").select("domain", "name", "run_id", "score", "flaws", "human_tier", "pitch")


#: Marks as requests send them: the pitch is JSON, which may be anything.
_SENT = """
SELECT concat(CASE WHEN doc_id % 29 = 0 THEN 'Bad Site' ELSE 'site' END, doc_id, '.in') AS domain, CASE WHEN doc_id % 31 = 0 THEN 'D' WHEN doc_id % 3 = 0 THEN 'A' END AS human_tier,
  CASE doc_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN ' false' WHEN 2 THEN '1' WHEN 3 THEN '"true"' WHEN 4 THEN 'null' END AS pitch_json FROM {labels}
"""


@query(f"""WITH n AS ({_SENT}), z AS (SELECT 'site' || c_custkey || '.in' AS domain FROM customer)
SELECT domain, human_tier, CASE WHEN starts_with(domain, 'Bad') THEN 'Invalid domain' WHEN human_tier = 'D' THEN 'human_tier must be A|B|C|X|null' WHEN trim(pitch_json) NOT IN ('true', 'false') THEN 'pitch must be boolean'
WHEN domain NOT IN (SELECT domain FROM z) THEN 'Unknown domain' END AS error FROM n""")
def sent_mark_checks(spark, sf_dir):
    known = view(spark, sf_dir, "SELECT concat('site', c_custkey, '.in') AS domain FROM {customer}")
    return assembly.checked_marks(view(spark, sf_dir, _SENT), known, known.limit(0)).select("domain", "human_tier", "error")


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INTEGER AS ordinal, lower(s_name) AS key, s_name || ' & Sons' AS value FROM supplier")
def config_map(spark, sf_dir):
    """Suppliers as an alias file of one JSON object, read back in its order."""
    path = new_folder(spark, "aliases")
    rows = view(spark, sf_dir, "SELECT lower(s_name) AS key, concat(s_name, ' & Sons') AS value, s_suppkey AS k FROM {supplier}")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("k", "key", "value"))), lambda e: F.struct(e["key"], e["value"]))
    note = F.array(F.struct(F.lit("_note").alias("key"), F.lit("not an alias").alias("value")))
    rows.agg(F.to_json(F.map_from_entries(F.concat(entries, note))).alias("value")).write.text(path)  # a configuration is one small file
    return config.read_map(spark, path)


_INDEX = "SELECT concat('site', c_custkey, '.in') AS domain, c_custkey % 83 AS score, CASE WHEN c_custkey % 7 <> 0 THEN concat(c_name, ' \"x\", é') END AS name FROM {customer}"


@query(f"WITH l AS ({_INDEX}) SELECT (row_number() OVER (ORDER BY score DESC, domain) - 1)::INTEGER AS place, domain, score, name FROM l")
def index_json(spark, sf_dir):
    """The index as one document, read back: the place of each lead in it."""
    path = f"{new_folder(spark, 'index')}/index.json"
    document.write_document(view(spark, sf_dir, _INDEX), path, [F.desc("score"), F.col("domain")], head={"city": "Coimbatore"})
    whole = spark.read.schema("city string, leads array<struct<domain: string, score: bigint, name: string>>").json(path, multiLine=True)
    return whole.select(F.posexplode("leads").alias("place", "l")).select("place", "l.*")
