"""Registered queries of lead assembly, reports and configuration, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadforge.operators import assembly, config, report
from leadforge.plans.views import duck, view

QUERIES = {}
ORACLE_SQL = {}

#: What the stages know of customers: businesses (some without a domain, name, address or phone, some twice), scores of those
#: with orders, measured signals of most, contacts from orders (numbers that several sites show), credits of suppliers.
BUSINESSES = """
SELECT c_mktsegment AS vertical, CASE WHEN c_custkey % 11 <> 0 THEN 'site' || CAST(c_custkey AS STRING) || '.in' END AS domain, c_custkey AS arrival,
  CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 41 AS DOUBLE) / 10 + 1 END AS rating,
  CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 211 END AS review_count, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Street ' || CAST(c_nationkey AS STRING) END AS address,
  CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN '123' ELSE '0' || CAST(7000000000 + c_custkey * 7 AS STRING) END AS phone,
  CASE WHEN c_custkey % 17 = 0 THEN 'aggregator-profile-only' WHEN c_custkey % 19 = 0 THEN 'aggregator-or-social-only' END AS skip_reason,
  CASE WHEN c_custkey % 3 = 0 THEN 'skip' WHEN c_custkey % 23 <> 0 THEN 'audit' END AS verdict, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 5 * (1 + length(c_mktsegment)) END AS raw_results
FROM {customer}
UNION ALL SELECT c_mktsegment, 'site' || CAST(c_custkey AS STRING) || '.in', c_custkey + 100000000, c_name || ' again', 4.5, 7, 'Second', '', NULL, 'audit', 0 FROM {customer} WHERE c_custkey % 37 = 5 AND c_custkey % 11 <> 0
"""
SCORES = """
SELECT c_mktsegment AS vertical, 'site' || CAST(c_custkey AS STRING) || '.in' AS domain, CAST(max(o_orderkey) % 101 AS INT) AS score,
  CASE WHEN max(o_orderkey) % 101 >= 62 THEN 'A' WHEN max(o_orderkey) % 101 >= 42 THEN 'B' WHEN max(o_orderkey) % 101 >= 24 THEN 'C' ELSE 'X' END AS tier,
  CASE WHEN c_custkey % 12 = 0 THEN 'no measurable pain' WHEN c_custkey % 12 = 1 THEN 'free or AI builder' WHEN c_custkey % 12 = 2 THEN '' END AS gate, CASE WHEN c_custkey % 4 <> 0 THEN 'angle ' || CAST(count(*) AS STRING) END AS pitch_angle
FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey
"""
SIGNALS = """
SELECT c_mktsegment AS vertical, 'site' || CAST(c_custkey AS STRING) || '.in' AS domain, CASE c_custkey % 4 WHEN 0 THEN 'expired 2023-04' WHEN 1 THEN 'http only' WHEN 2 THEN 'ok' END AS https,
  CASE WHEN c_custkey % 3 = 0 THEN '120px' ELSE 'none' END AS overflow, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'form broken' END AS quoteform
FROM {customer} WHERE c_custkey % 7 <> 0
"""
CONTACTS = """
SELECT c_mktsegment AS vertical, 'site' || CAST(c_custkey AS STRING) || '.in' AS domain, CASE o_orderkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'instagram' ELSE 'phone' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'Info' || CAST(o_orderkey % 4001 AS STRING) || '@mail.in' WHEN 1 THEN 'handle' || CAST(c_custkey AS STRING) ELSE '+91 98765-' || CAST(10000 + o_orderkey % 7919 AS STRING) END AS value, o_orderkey AS seq
FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE c_custkey % 4 <> 2
"""
LINKS = """
SELECT c_mktsegment AS vertical, 'site' || CAST(c_custkey AS STRING) || '.in' AS domain, CAST(c_custkey % 90 AS INT) AS links,
  CASE WHEN c_custkey % 3 <> 0 THEN s_name END AS agency_name, CASE WHEN c_custkey % 3 = 1 THEN 'agency' || CAST(s_suppkey AS STRING) || '.in' END AS agency_domain, CASE WHEN c_custkey % 3 <> 0 THEN 'Designed by ' || s_name END AS credit
FROM {customer} JOIN {supplier} ON s_suppkey = c_custkey % 10 + 1 WHERE c_custkey % 5 <> 3
"""
MARKS = """
SELECT 'site' || CAST(doc_id AS STRING) || '.in' AS domain, CASE quality * 2 + toxic WHEN 0 THEN 'C' WHEN 1 THEN 'X' WHEN 2 THEN 'A' END AS human_tier, CASE WHEN toxic = 0 THEN quality = 1 END AS pitch,
  CASE WHEN doc_id % 3 = 0 THEN 'call, then "mail"' END AS note FROM {labels}
"""
_WITH = f"""
WITH b AS ({BUSINESSES}), s AS ({SCORES}), g AS ({SIGNALS}), c0 AS ({CONTACTS}), l AS ({LINKS}), m AS ({MARKS}),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vertical, domain ORDER BY arrival DESC) AS r FROM b WHERE domain IS NOT NULL) WHERE r = 1),
k AS (SELECT *, regexp_replace(phone, '^0([0-9]{{10}})$', '\\1') AS pk FROM own),
c1 AS (SELECT vertical, domain, kind, value, seq, NULL AS owner FROM c0 UNION ALL
  SELECT vertical, domain, 'phone', phone, 4611686018427387904, 'places' FROM k WHERE length(pk) >= 7 AND (vertical, domain) NOT IN (SELECT (vertical, domain) FROM c0 WHERE kind = 'phone')),
c2 AS (SELECT *, CASE WHEN kind = 'phone' THEN CASE WHEN regexp_matches(regexp_replace(value, '[^0-9]', '', 'g'), '^(91|0)[0-9]{{10}}$') THEN right(regexp_replace(value, '[^0-9]', '', 'g'), 10) ELSE regexp_replace(value, '[^0-9]', '', 'g') END
  WHEN kind = 'email' THEN lower(value) ELSE value END AS key FROM c1),
c3 AS (SELECT c2.*, n FROM c2 JOIN (SELECT kind, key, count(DISTINCT domain) AS n FROM c2 GROUP BY kind, key) USING (kind, key)),
c AS (SELECT vertical, domain, kind, value, seq, CASE WHEN owner = 'places' THEN owner WHEN n > 1 THEN 'agency' ELSE 'business' END AS owner FROM c3),
lead AS (SELECT g.vertical, g.domain, coalesce(nullif(own.name, ''), g.domain) AS name, coalesce(own.rating, 0) AS rating, coalesce(own.review_count, 0) AS reviews,
  coalesce(nullif(own.address, ''), 'none') AS address, s.score, s.tier, nullif(s.gate, '') AS gate, coalesce(s.pitch_angle, '') AS pitch_angle,
  coalesce((SELECT first(value ORDER BY seq) FROM c WHERE c.vertical = g.vertical AND c.domain = g.domain AND kind = 'phone' AND owner = 'business'), '') AS phone,
  coalesce((SELECT first(value ORDER BY seq) FROM c WHERE c.vertical = g.vertical AND c.domain = g.domain AND kind = 'email' AND owner = 'business'), '') AS email,
  l.links, l.agency_name, l.agency_domain, l.credit, g.https, g.overflow, g.quoteform
  FROM g JOIN s USING (vertical, domain) LEFT JOIN own USING (vertical, domain) LEFT JOIN l USING (vertical, domain))
"""
_FLAWS = "list_filter([CASE WHEN https <> 'ok' THEN 'https' END, CASE WHEN overflow <> 'none' THEN 'overflow' END, CASE WHEN quoteform <> 'none' THEN 'quoteForm' END], lambda x: x IS NOT NULL)"
#: A configuration as it is read from its files.
ANGLES = [
    (0, "cert-expired", ["https"], "expired", "Visitors are warned off before your page opens."), (1, "no-https", ["https"], "http only", "Browsers call your site not secure."),
    (2, "form-and-phone", ["quoteForm", "overflow"], None, "Your form does not work and your page does not fit a phone."), (3, "overflow", ["overflow"], None, "Your page does not fit a phone."), (4, "generic", [], None, "Your site could bring more calls."),
]
REASONS = [(0, "https", "The connection is not safe."), (1, "overflow", "The page is wider than a phone.")]
ALIASES = [(0, "#00000000", "Zero House"), (1, "supplier#000000007", "Seven Studio")]
VERTICALS = [("BUILDING", "Builders", 2, True), ("AUTOMOBILE", "Cars", 1, True), ("MACHINERY", "Machines", 3, False), ("FLORISTS", "Florists", 4, True), ("HOUSEHOLD", "Homes", 5, True)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of all sites with their owner, provider numbers included."""
    found = view(spark, sf_dir, CONTACTS).withColumn("owner", F.lit(None).cast("string"))
    every = assembly.with_provider_phones(found, view(spark, sf_dir, BUSINESSES))
    return report.contact_owner(every.withColumns({"key": report.contact_key(F.col("kind"), F.col("value")), "credit": F.lit("")})).select("vertical", "domain", "kind", "value", "seq", "owner")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = view(spark, sf_dir, SIGNALS)
    table = F.create_map(F.lit("https"), F.col("https"), F.lit("overflow"), F.col("overflow"), F.lit("quoteForm"), F.col("quoteform"))
    lists = assembly.contact_lists(contacts(spark, sf_dir)).withColumn("page_address", F.lit(None).cast("string"))
    scores = view(spark, sf_dir, SCORES).withColumn("flaws", F.array().cast("array<string>"))
    out = assembly.assemble(scores, signals.withColumn("signals", table), view(spark, sf_dir, BUSINESSES), lists, view(spark, sf_dir, LINKS))
    s = {k: F.col("signals")[k] for k in ("https", "overflow", "quoteForm")}
    return out.withColumn("flaws", F.array_compact(F.array(F.when(s["https"] != "ok", "https"), F.when(s["overflow"] != "none", "overflow"), F.when(s["quoteForm"] != "none", "quoteForm"))))


@query(_WITH + "SELECT vertical, domain, name, rating, reviews::BIGINT AS reviews, address, score, tier, gate, pitch_angle, links, agency_name, credit IS NOT NULL AS has_agency FROM lead")
def lead_assembly(spark, sf_dir):
    return leads(spark, sf_dir).select("vertical", "domain", "name", "rating", F.col("reviews").cast("bigint").alias("reviews"), "address", "score", "tier", "gate", "pitch_angle", "links", F.col("agency.name").alias("agency_name"), F.col("agency").isNotNull().alias("has_agency"))


@query(_WITH + "SELECT vertical, domain, count(*) AS contacts, count(*) FILTER (owner = 'agency') AS shared, count(*) FILTER (owner = 'places') AS given, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM c GROUP BY vertical, domain")
def lead_contacts(spark, sf_dir):
    lists = assembly.contact_lists(contacts(spark, sf_dir))
    of = lambda who: F.size(F.filter("contacts", lambda c: c["owner"] == who)).cast("bigint")
    return lists.select("vertical", "domain", F.size("contacts").cast("bigint").alias("contacts"), of("agency").alias("shared"), of("places").alias("given"), F.array_join(assembly.contact_kinds(F.col("contacts")), ",").alias("kinds"))


def _quoted(*cells: str) -> str:
    return " || ',' || ".join(f"""'"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '"', '""') || '"'""" for c in cells)


_LEAD_CELLS = ("tier", "score", "vertical", "domain", "name", "address", "phone", "email", "rating", "reviews", "coalesce(agency_name, '')", "pitch_angle")


@query(_WITH + f"SELECT domain, {_quoted(*_LEAD_CELLS)} AS line FROM lead")
def leads_csv(spark, sf_dir):
    rows = assembly.lead_rows(leads(spark, sf_dir))
    return rows.select("domain", assembly.csv_line(rows).alias("line"))


@query(_WITH + f"SELECT domain, {_quoted(*_LEAD_CELLS, 'human_tier', 'note')} AS line FROM lead JOIN m USING (domain) WHERE pitch")
def pitch_csv(spark, sf_dir):
    rows = assembly.pitch_rows(leads(spark, sf_dir), view(spark, sf_dir, MARKS))
    return rows.select("domain", assembly.csv_line(rows).alias("line"))


_SAVED_CELLS = ("domain", "name", "vertical", "address", "phone", "email", "rating", "reviews", "tier", "score", "human_tier", "pitch_angle", "note", "coalesce(agency_name, '')")


@query(_WITH + f"SELECT domain, {_quoted(*_SAVED_CELLS)} AS line FROM lead JOIN m USING (domain) WHERE pitch")
def saved_pitch_csv(spark, sf_dir):
    rows = assembly.saved_rows(leads(spark, sf_dir), view(spark, sf_dir, MARKS))
    return rows.select("domain", assembly.csv_line(rows).alias("line"))


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies of the credits, with published prices of some."""
    own = leads(spark, sf_dir).where("agency IS NOT NULL").select(F.col("agency.name").alias("name"), F.coalesce("agency.domain", F.lower("agency.name")).alias("domain"))
    out = own.groupBy("domain").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("built_in_run"))
    price = lambda tier, k: F.struct(F.lit(tier).alias("tier"), F.concat(F.lit("Rs "), (F.length("name") * k).cast("string")).alias("price"))
    pricing = F.when(F.col("built_in_run") % 2 == 0, F.array(price("basic", 100), price("plus", 300))).otherwise(F.array().cast("array<struct<tier:string,price:string>>"))
    return out.withColumns({"pricing": pricing, "portfolio_clients": F.col("built_in_run") + 1, "note": F.lit(None).cast("string")})


_AGENCIES = ", a AS (SELECT coalesce(agency_domain, lower(agency_name)) AS domain, min(agency_name) AS name, count(*) AS built_in_run FROM lead WHERE credit IS NOT NULL GROUP BY 1) "


@query(_WITH + _AGENCIES + "SELECT name AS agency, domain, built_in_run, built_in_run + 1 AS portfolio_clients, CASE WHEN built_in_run % 2 = 0 THEN 'basic Rs ' || length(name) * 100 || ' | plus Rs ' || length(name) * 300 ELSE '' END AS published_pricing, '' AS note FROM a")
def agencies_csv(spark, sf_dir):
    return assembly.agency_rows(agencies(spark, sf_dir))


@query(_WITH + _AGENCIES + ", o AS (SELECT agency_domain AS domain, string_agg(domain, ',' ORDER BY score DESC, domain) AS leads FROM lead WHERE agency_domain IS NOT NULL GROUP BY 1) SELECT domain, name, coalesce(leads, '') AS leads FROM a LEFT JOIN o USING (domain)")
def agency_chips(spark, sf_dir):
    return assembly.agency_chips(agencies(spark, sf_dir), leads(spark, sf_dir)).select("domain", "name", F.array_join("leads", ",").alias("leads"))


_REASONS = "CASE WHEN gate IS NOT NULL THEN '' ELSE array_to_string(list_filter(list_transform((" + _FLAWS + ")[1:5], lambda k: CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for _, k, v in REASONS) + " END), lambda x: x IS NOT NULL), ' ') END"


@query(_WITH + f"""SELECT vertical, domain, score, {_REASONS} AS reasons, agency_domain, credit, vertical || '/' || domain || '/mobile.webp' AS shot,
(SELECT count(*) FROM c WHERE c.vertical = lead.vertical AND c.domain = lead.domain AND owner = 'business') AS contacts, array_to_string({_FLAWS}, ',') AS flaws FROM lead""")
def index_document(spark, sf_dir):
    known = config.pairs(spark.createDataFrame(REASONS, config.PAIRS))
    out = assembly.index_leads(leads(spark, sf_dir), config.reasons(F.col("flaws"), F.col("gate"), known))
    return out.select("vertical", "domain", "score", F.array_join("reasons", " ").alias("reasons"), F.col("agency.domain").alias("agency_domain"), F.col("agency.credit").alias("credit"), F.col("shots.mobile").alias("shot"), F.size("contacts").cast("bigint").alias("contacts"), F.array_join("flaws", ",").alias("flaws"))


@query(_WITH + "SELECT v.* EXCLUDE (enabled), CASE WHEN coalesce(raw, 0) = 0 THEN coalesce(n, 0) ELSE raw END::BIGINT AS discovered, coalesce(d, 0) AS with_domain, coalesce(a, 0) AS audited FROM (VALUES " + ", ".join(map(str, VERTICALS)).replace("True", "true").replace("False", "false") + ") v(vertical, label, priority, enabled) LEFT JOIN (SELECT vertical, max(raw_results) AS raw, count(*) AS n, count(domain) AS d, count(*) FILTER (verdict = 'audit') AS a FROM b GROUP BY vertical) USING (vertical) WHERE enabled")
def vertical_index(spark, sf_dir):
    verticals = spark.createDataFrame(VERTICALS, "vertical string, label string, priority int, enabled boolean")
    return assembly.vertical_index(verticals, view(spark, sf_dir, BUSINESSES)).withColumn("discovered", F.col("discovered").cast("bigint"))


@query(_WITH + "SELECT s.vertical, count(own.domain) AS ok, count(*) - count(own.domain) AS err FROM s LEFT JOIN own USING (vertical, domain) GROUP BY s.vertical")
def score_matching(spark, sf_dir):
    return assembly.stage_counts(assembly.matched(view(spark, sf_dir, SCORES), view(spark, sf_dir, BUSINESSES)))


_PICK = "CASE WHEN gate = 'no measurable pain' THEN 'No measurable pain. Skip.' WHEN gate IS NOT NULL THEN 'Gate: ' || gate || '.' " + " ".join(
    "WHEN " + " AND ".join([f"list_contains({_FLAWS}, '{k}')" for k in when] + ([f"contains(lower({when[0].lower()}), '{guard}')"] if guard else []) or ["true"]) + f" THEN '{words}'" for _, _, when, guard, words in ANGLES
) + " END"


@query(_WITH + f"SELECT vertical, domain, {_PICK} AS pitch FROM lead")
def angle_text(spark, sf_dir):
    choices = config.angles(spark.createDataFrame(ANGLES, config.ANGLES))
    signals = {k: F.col("signals")[k] for k in ("https", "overflow", "quoteForm")}
    return leads(spark, sf_dir).select("vertical", "domain", config.pick_angle(F.col("flaws"), signals, F.col("gate"), choices)["text"].alias("pitch"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Designs By ' || s_suppkey WHEN contains(lower(s_name), '#00000000') THEN 'Zero House' ELSE s_name END AS name FROM supplier")
def agency_alias(spark, sf_dir):
    raw = view(spark, sf_dir, "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN ' designs   by ' || CAST(s_suppkey AS STRING) || '.,' ELSE s_name || '!' END AS raw FROM {supplier}")
    return raw.select("s_suppkey", config.canonical_name(F.col("raw"), config.pairs(spark.createDataFrame(ALIASES, config.PAIRS))).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'none' WHEN p_size % 4 = 1 THEN 'nova (Nova Shop)' ELSE 'theme' || p_size END AS theme FROM part")
def theme_slug(spark, sf_dir):
    slug = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "nova").otherwise(F.concat(F.lit("theme"), F.col("p_size").cast("string")))
    return view(spark, sf_dir, "SELECT p_partkey, p_size FROM {part}").select("p_partkey", config.theme_note(slug, [("nova", "Nova Shop")]).alias("theme"))


@query(_WITH + f", u AS (SELECT vertical, domain, {_FLAWS} AS f, unnest(['https', 'overflow', 'quoteForm']) AS signal, unnest([https, overflow, quoteform]) AS value FROM lead) SELECT vertical, domain, signal, value, list_contains(f, signal) AS flaw FROM u WHERE value IS NOT NULL")
def deck_signals(spark, sf_dir):
    return assembly.deck_signals(leads(spark, sf_dir))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = view(spark, sf_dir, MARKS)
    odd = F.xxhash64("domain").isNotNull() & (F.length("domain") % 2 == 0)
    return assembly.merged_reviews(leads(spark, sf_dir), marks.where(odd), marks.where(~odd).withColumn("note", F.lit("saved")))


_REVIEWED = ", r AS (SELECT lead.*, human_tier, coalesce(pitch, false) AS pitch, CASE WHEN length(domain) % 2 = 1 AND m.domain IS NOT NULL THEN 'saved' ELSE coalesce(note, '') END AS note FROM lead LEFT JOIN m USING (domain)) "


@query(_WITH + _REVIEWED.replace("m.domain", "m.domain") + "SELECT domain, human_tier, pitch, note FROM r")
def review_merge(spark, sf_dir):
    return reviewed(spark, sf_dir)


@query(_WITH + _REVIEWED + "SELECT 'all' AS shown, count(*) AS leads, max(reviews)::BIGINT AS most FROM r UNION ALL SELECT 'unreviewed', count(*), max(reviews)::BIGINT FROM r WHERE human_tier IS NULL UNION ALL SELECT 'pitch', count(*), max(reviews)::BIGINT FROM r WHERE pitch UNION ALL SELECT 'A', count(*), max(reviews)::BIGINT FROM r WHERE tier = 'A'")
def grid_filter(spark, sf_dir):
    rows = leads(spark, sf_dir).join(reviewed(spark, sf_dir), "domain")
    parts = [assembly.grid(rows, s).agg(F.lit(s).alias("shown"), F.count(F.lit(1)).alias("leads"), F.max(F.col("reviews").cast("bigint")).alias("most")) for s in ("all", "unreviewed", "pitch", "A")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(_WITH + "SELECT vertical, " + ", ".join(f"floor(count(*) FILTER (tier = '{t}')::DOUBLE / count(*) * 10000 + 0.5) / 100 AS share_{t.lower()}" for t in "ABCX") + " FROM lead GROUP BY vertical")
def tier_share(spark, sf_dir):
    return assembly.tier_share(leads(spark, sf_dir))


@query(_WITH + "SELECT vertical, count(*) AS total, count(domain) AS with_domain, count(*) FILTER (skip_reason = 'aggregator-profile-only') AS greenfield FROM b GROUP BY vertical")
def discover_counts(spark, sf_dir):
    return assembly.discover_counts(view(spark, sf_dir, BUSINESSES))


@query(_WITH + "SELECT vertical, domain, arrival FROM (SELECT * FROM b ORDER BY arrival LIMIT 500) WHERE domain IS NOT NULL AND skip_reason IS NULL AND verdict = 'audit'")
def audit_queue(spark, sf_dir):
    return assembly.audit_queue(assembly.auditable(assembly.first_arrivals(view(spark, sf_dir, BUSINESSES), 500))).select("vertical", "domain", "arrival")


@query(_WITH + """, n AS (SELECT CASE WHEN doc_id % 29 = 0 THEN 'Bad Domain' ELSE 'site' || doc_id || '.in' END AS domain, CASE WHEN doc_id % 31 = 0 THEN 'D' WHEN doc_id % 3 = 0 THEN 'A' END AS human_tier FROM labels),
z AS (SELECT domain FROM b WHERE domain IS NOT NULL UNION SELECT domain FROM s)
SELECT domain, human_tier, CASE WHEN domain = 'Bad Domain' THEN 'Invalid domain' WHEN human_tier = 'D' THEN 'human_tier must be A|B|C|X|null' WHEN domain NOT IN (SELECT domain FROM z) THEN 'Unknown domain' END AS error FROM n""")
def mark_checks(spark, sf_dir):
    marks = view(spark, sf_dir, "SELECT CASE WHEN doc_id % 29 = 0 THEN 'Bad Domain' ELSE 'site' || CAST(doc_id AS STRING) || '.in' END AS domain, CASE WHEN doc_id % 31 = 0 THEN 'D' WHEN doc_id % 3 = 0 THEN 'A' END AS human_tier FROM {labels}")
    return assembly.checked_marks(marks, view(spark, sf_dir, BUSINESSES), view(spark, sf_dir, SCORES))


@query("SELECT 'user' || user_id AS domain, min(year(ts)) AS first_year, max(year(ts)) AS last_year FROM events GROUP BY user_id")
def archive_years(spark, sf_dir):
    return assembly.archive_years(view(spark, sf_dir, "SELECT 'user' || CAST(user_id AS STRING) AS domain, ts AS seen FROM {events}"))


@query("""WITH l AS (SELECT l_suppkey AS site, 'p' || l_partkey || '/' || l_linenumber AS href, l_orderkey * 10 + l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'social' ELSE 'internal' END AS kind FROM lineitem),
d AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY site, href ORDER BY pos) AS r FROM l) WHERE r = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY pos) AS place FROM d)
SELECT site, count(*) AS total, count(*) FILTER (kind = 'internal') AS internal, count(*) FILTER (kind = 'external') AS "external", count(*) FILTER (kind = 'social') AS social,
count(*) FILTER (kind = 'internal' AND place <= 40 AND regexp_extract(href, '^p([0-9]+)', 1)::INTEGER % 6 = 0) AS dead FROM q GROUP BY site""")
def dead_links(spark, sf_dir):
    links = view(spark, sf_dir, "SELECT l_suppkey AS site, 'p' || CAST(l_partkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS href, l_orderkey * 10 + l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'social' ELSE 'internal' END AS kind, CASE WHEN l_partkey % 6 = 0 THEN 404 WHEN l_partkey % 6 <> 1 THEN 200 END AS status FROM {lineitem}")
    first = links.groupBy("site", "href").agg(F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"))
    return assembly.dead_links(first, links.select("href", "status").distinct(), "site")
