"""Registered queries of the lead operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadforge.functions import numbers, strings, urls
from leadforge.operators import classify, dedupe, flags, report, scoring, tiles
from leadforge.plans.views import LEADS, LISTINGS, REVIEWS, YEAR, duck, leads, view

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _num(c: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({c}, '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE)"


def _yr(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER)"


def _r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5e0) / 100)"


def _cap(c: str, per: str, cap: str) -> str:
    return f"greatest(0e0, least({cap}, coalesce({_num(c)}, 0e0) * {per}))"


def _has(c: str) -> str:
    return f"lower({c}) NOT IN ('', 'none', 'missing', 'n/a', 'no')"


_BUCKET = f"CASE WHEN {_num('lcp')} IS NULL THEN 'ok' WHEN {_num('lcp')} < 2.5 THEN 'fast' WHEN {_num('lcp')} < 4 THEN 'ok' WHEN {_num('lcp')} < 6 THEN 'slow' ELSE 'dire' END"
_OLD_WP = r"coalesce(TRY_CAST(nullif(regexp_extract(generator, '(?i)wordpress\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) < 5.5, false)"
_SLIDER = "regexp_matches(slider, '(?i)revslider|revolution|nivo|owl|cycle|flexslider')"
_STALE = _r2(
    f"CASE WHEN coalesce({_yr('redesigned')}, {_yr('copyright')}, {_yr('wayback')}) IS NULL THEN 0e0 ELSE greatest(0, least(11, {YEAR} - coalesce({_yr('redesigned')}, {_yr('copyright')}, {_yr('wayback')}))) * 4e0 END"
    f" + CASE WHEN {_yr('wayback')} IS NOT NULL AND {_yr('redesigned')} IS NULL AND lower(redesigned) <> 'n/a' THEN 6e0 ELSE 0e0 END"
    f" + CASE WHEN {_num('jquery')} < 3 THEN 5e0 ELSE 0e0 END + CASE WHEN {_num('bootstrap')} < 4 THEN 3e0 ELSE 0e0 END"
    f" + CASE WHEN {_SLIDER} THEN 5e0 ELSE 0e0 END + CASE WHEN {_OLD_WP} THEN 4e0 ELSE 0e0 END"
    " + CASE WHEN regexp_matches(generator, '(?i)frontpage|static html|table') OR regexp_matches(theme, '(?i)table') THEN 4e0 ELSE 0e0 END"
)
_MOBILE = _r2(f"CASE WHEN viewport = 'missing' THEN 14e0 ELSE 0e0 END + {_cap('overflow', '0.04e0', '12e0')} + {_cap('tapTargets', '0.35e0', '7e0')}")
_TRUST = _r2(
    "CASE WHEN regexp_matches(https, 'none|http only|^no$') THEN 18e0 WHEN regexp_matches(https, 'expired|invalid|self') THEN 20e0 ELSE 0e0 END"
    f" + {_cap('mixedContent', '0.8e0', '6e0')} + {_cap('brokenImages', '1.2e0', '8e0')} + greatest(0e0, least(5e0, dead_links::DOUBLE * 0.6e0))"
)
_PERF = _r2(f"CASE {_BUCKET} WHEN 'fast' THEN 0e0 WHEN 'ok' THEN 3e0 WHEN 'slow' THEN 7e0 ELSE 11e0 END + {_cap('pageWeight', '0.7e0', '8e0')} + CASE WHEN {_has('heroVideo')} THEN 2e0 ELSE 0e0 END")
_PAY0 = "sqrt(greatest(0, least(120, reviews)) / 120e0)"
_PAY1 = f"CASE WHEN rating <> 0 AND rating < 3.8e0 THEN {_PAY0} * 0.75e0 ELSE {_PAY0} END"

SCORED = f"""
WITH leads AS ({LEADS}),
a AS (SELECT *, {_STALE} AS staleness, {_MOBILE} AS mobile, {_TRUST} AS trust, {_PERF} AS perf, {_PAY1} AS pay1, {_BUCKET} AS lcp_bucket,
        CASE WHEN has_phone AND (has_email OR has_instagram) THEN 1e0 WHEN has_phone OR has_email THEN 0.8e0 ELSE 0.4e0 END AS reach FROM leads),
b AS (SELECT *, {_r2('staleness + mobile + trust + perf')} AS pain, CASE WHEN coalesce({_num('domainAge')}, 0e0) >= 5 THEN pay1 * 0.85e0 + 0.15e0 ELSE pay1 END AS pay2 FROM a),
c AS (SELECT *, CASE WHEN agency THEN pay2 * 0.8e0 + 0.2e0 ELSE pay2 END AS pay3 FROM b),
d AS (SELECT *, {_r2(f"greatest(0e0, least(1e0, CASE WHEN {_has('whatsapp')} OR {_has('quoteForm')} THEN pay3 * 0.9e0 + 0.1e0 ELSE pay3 END))")} AS pay FROM c),
e AS (SELECT *, floor(greatest(0e0, least(100e0, greatest(0e0, least(1e0, pain / 150e0)) * pay * reach * 2.25e0 * 100)) + 0.5e0)::INTEGER AS raw,
        CASE WHEN regexp_matches(generator || ' ' || theme, '(?i)ai site builder|wix|weebly|godaddy builder|builder default') THEN 'free or AI builder'
          WHEN CASE WHEN {_num('domainAge')} = 0 THEN 99e0 ELSE coalesce({_num('domainAge')}, 99e0) END < 1 AND reviews < 10 THEN 'young domain with few reviews'
          WHEN pain < 12 THEN 'no measurable pain' WHEN reviews < 20 AND pain > 45 THEN 'much pain and little budget' END AS gate FROM d),
f AS (SELECT *, CASE WHEN gate = 'no measurable pain' THEN 'X' WHEN gate IS NOT NULL THEN 'C' WHEN raw >= 62 THEN 'A' WHEN raw >= 42 THEN 'B' WHEN raw >= 24 THEN 'C' ELSE 'X' END AS tier FROM e),
scored AS (SELECT *, CASE WHEN gate IS NULL THEN raw WHEN tier = 'X' THEN least(raw, 23) ELSE least(raw, 43) END AS score FROM f)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(leads(spark, sf_dir), YEAR)


@query(SCORED + "SELECT domain, vertical, staleness, mobile, trust, perf, pain, pay, reach, score, tier, gate, lcp_bucket FROM scored")
def lead_score(spark, sf_dir):
    return scored(spark, sf_dir).select("domain", "vertical", "staleness", "mobile", "trust", "perf", "pain", "pay", "reach", "score", "tier", "gate", "lcp_bucket").orderBy(F.desc("score"), "domain")


@query(SCORED + "SELECT vertical, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'B') AS tier_b, count(*) FILTER (tier = 'C') AS tier_c, count(*) FILTER (tier = 'X') AS tier_x, count(*) AS total FROM scored GROUP BY vertical")
def tier_pivot(spark, sf_dir):
    return report.tier_pivot(scored(spark, sf_dir))


@query(SCORED + "SELECT coalesce(gate, 'open') AS gate, tier, count(*) AS leads, min(score) AS lowest, max(score) AS highest FROM scored GROUP BY 1, 2")
def lead_gate(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.coalesce("gate", F.lit("open")).alias("gate"), "tier").agg(F.count(F.lit(1)).alias("leads"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query(SCORED + "SELECT lcp_bucket, count(*) AS leads, sum(CASE WHEN score >= 62 THEN 1 ELSE 0 END)::BIGINT AS hot FROM scored GROUP BY lcp_bucket")
def lcp_buckets(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lcp_bucket").agg(F.count(F.lit(1)).alias("leads"), F.count_if(F.col("score") >= 62).alias("hot"))


_RULES = {
    "https": "https <> 'ok'", "viewport": "viewport = 'missing'", "overflow": f"{_num('overflow')} > 0", "lcp": f"{_BUCKET} IN ('slow', 'dire')", "pageWeight": f"{_num('pageWeight')} > 4",
    "brokenImages": f"{_num('brokenImages')} >= 1", "tapTargets": f"{_num('tapTargets')} >= 5", "mixedContent": "mixedContent <> 'none'",
    "redesigned": f"(redesigned = 'never' OR {_yr('redesigned')} <= {YEAR - 6})", "jquery": f"{_num('jquery')} < 3", "slider": _SLIDER, "copyright": f"{_yr('copyright')} <= {YEAR - 5}",
    "generator": f"({_OLD_WP} OR regexp_matches(generator, '(?i)frontpage|static html'))", "bootstrap": f"{_num('bootstrap')} < 4", "heroVideo": "heroVideo <> 'none'",
    "whatsapp": "whatsapp = 'none'", "quoteForm": "quoteForm = 'none'", "blog": f"{_yr('blog')} <= {YEAR - 3}", "domainAge": f"{_num('domainAge')} < 1",
}
_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN {_RULES[k]} THEN '{k}' END" for k in flags.ORDER) + "], lambda x: x IS NOT NULL)"
FLAGGED = SCORED.rstrip() + f", flagged AS (SELECT *, {_FLAGS} AS flags FROM scored)\n"


def with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {k: F.col(k) for k in scoring.SIGNALS}
    out = scored(spark, sf_dir).withColumn("flags", flags.flagged(s, YEAR))
    return out.withColumn("angle", flags.angle(F.col("flags"), s, F.col("gate")))


@query(FLAGGED + "SELECT domain, array_to_string(flags, ',') AS flags, len(flags)::INTEGER AS n_flags FROM flagged")
def flag_order(spark, sf_dir):
    return with_flags(spark, sf_dir).select("domain", F.array_join("flags", ",").alias("flags"), F.size("flags").alias("n_flags"))


_ANGLE = "CASE WHEN gate IS NOT NULL THEN 'gate' " + " ".join(
    "WHEN " + " AND ".join([f"list_contains(flags, '{k}')" for k in needs] + ([f"contains(lower({needs[0]}), '{guard}')"] if guard else []) or ["true"]) + f" THEN '{name}'" for name, needs, guard in flags.ANGLES
) + " END"


@query(FLAGGED + f"SELECT domain, {_ANGLE} AS angle, CASE WHEN gate IS NULL THEN {_ANGLE} WHEN gate = 'no measurable pain' THEN 'No measurable pain. Skip.' ELSE 'Gate: ' || gate || '.' END AS pitch FROM flagged")
def angle_pick(spark, sf_dir):
    return with_flags(spark, sf_dir).select("domain", "angle", flags.pitch(F.col("angle"), F.col("gate")).alias("pitch"))


@query(FLAGGED + "SELECT domain, array_to_string(list_transform(flags[1:5], lambda k: MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in flags.REASONS.items()) + "}[k]), ' ') AS reasons FROM flagged")
def reason_top5(spark, sf_dir):
    return with_flags(spark, sf_dir).select("domain", F.array_join(flags.reasons(F.col("flags")), " ").alias("reasons"))


MARKED = SCORED.rstrip() + f", reviews AS ({REVIEWS}), marked AS (SELECT s.*, r.human_tier, r.pitch FROM scored s LEFT JOIN reviews r USING (k))\n"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).join(view(spark, sf_dir, REVIEWS), "k", "left")


@query(MARKED + "SELECT count(human_tier) AS judged, count(*) FILTER (tier = human_tier) AS agreed, floor(100e0 * count(*) FILTER (tier = human_tier) / count(human_tier) + 0.5e0)::BIGINT AS rate FROM marked")
def agreement_rate(spark, sf_dir):
    return report.agreement(marked(spark, sf_dir))


@query(MARKED + "SELECT domain, score, tier, human_tier, CASE WHEN strpos('ABCX', tier) > strpos('ABCX', human_tier) THEN 'up' ELSE 'down' END AS drift FROM marked WHERE tier <> human_tier")
def disagreements(spark, sf_dir):
    out = marked(spark, sf_dir).where(F.col("tier") != F.col("human_tier"))
    return out.select("domain", "score", "tier", "human_tier", report.drift(F.col("tier"), F.col("human_tier")).alias("drift")).orderBy(F.desc("score"), "domain")


@query(MARKED + "SELECT domain, score, tier, human_tier FROM marked WHERE pitch")
def pitch_queue(spark, sf_dir):
    return marked(spark, sf_dir).where("pitch").select("domain", "score", "tier", "human_tier").orderBy(F.desc("score"), "domain")


@query(MARKED + """SELECT domain, row_number() OVER w AS place, lead(domain) OVER w || coalesce(',' || lead(domain, 2) OVER w, '') || coalesce(',' || lead(domain, 3) OVER w, '') AS next_three,
first_value(CASE WHEN human_tier IS NULL THEN domain END IGNORE NULLS) OVER (PARTITION BY vertical ORDER BY score DESC, domain ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_unreviewed
FROM marked WINDOW w AS (PARTITION BY vertical ORDER BY score DESC, domain)""")
def review_deck(spark, sf_dir):
    return report.deck(marked(spark, sf_dir)).select("domain", "place", F.nullif(F.array_join("next_three", ","), F.lit("")).alias("next_three"), "next_unreviewed")


@query(SCORED + """SELECT vertical, count(*) AS leads, count(*) FILTER (tier = 'A') AS hot, sum(score)::BIGINT AS score FROM scored GROUP BY ROLLUP (vertical)""")
def grand_totals(spark, sf_dir):
    return scored(spark, sf_dir).rollup("vertical").agg(F.count(F.lit(1)).alias("leads"), F.count_if(F.col("tier") == "A").alias("hot"), F.sum("score").alias("score"))


@query(SCORED + """SELECT '"' || domain || '","' || replace(name, '"', '""') || '","' || score || '","' || tier || '","' || coalesce(gate, '') || '"' AS line FROM scored""")
def csv_rows(spark, sf_dir):
    out = scored(spark, sf_dir)
    return out.select(report.csv_lines(out, "domain", "name", "score", "tier", "gate").alias("line"))


@query(SCORED + "SELECT domain, tier, score, to_json({'staleness': staleness, 'mobile': mobile, 'trust': trust, 'perf': perf}) IS NOT NULL AS has_parts, gate IS NULL AS is_open FROM scored")
def index_lead(spark, sf_dir):
    parts = F.struct("staleness", "mobile", "trust", "perf")
    return scored(spark, sf_dir).select("domain", "tier", "score", F.to_json(parts).isNotNull().alias("has_parts"), F.col("gate").isNull().alias("is_open"))


LISTED = f"""
WITH raw AS ({LISTINGS}), l AS (SELECT *, regexp_replace(regexp_extract(website, '//([^/]+)', 1), '^www\\.', '') AS host FROM raw),
c AS (SELECT *, CASE WHEN host IN ('99acres.com') THEN 'aggregator-profile-only' WHEN website IS NULL OR host IN ('facebook.com') THEN 'aggregator-or-social-only' END AS skip_reason FROM l)
"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, LISTINGS)
    return out.withColumns({"domain": urls.registrable(F.col("website")), "skip_reason": classify.skip_reason(F.col("website"))})


@query(LISTED + "SELECT provider_id, CASE WHEN skip_reason IS NULL THEN host END AS domain, skip_reason FROM c")
def domain_classify(spark, sf_dir):
    return listings(spark, sf_dir).select("provider_id", F.when(F.col("skip_reason").isNull(), F.col("domain")).alias("domain"), "skip_reason")


@query(LISTED + "SELECT coalesce(skip_reason, 'none') AS reason, count(*) AS listings FROM c GROUP BY 1")
def skip_histogram(spark, sf_dir):
    return listings(spark, sf_dir).groupBy(F.coalesce("skip_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("listings")).orderBy(F.desc("listings"))


@query("WITH e AS (SELECT user_id, event_id, ts, event_type FROM events) SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM e) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    return dedupe.keep_first(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(LISTED + """, m AS (SELECT *, max(review_count) OVER (PARTITION BY host ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE skip_reason IS NULL),
k AS (SELECT *, before IS NULL OR review_count > before AS leads FROM m),
win AS (SELECT host, max(arrival) FILTER (leads) AS w FROM k GROUP BY host),
ph AS (SELECT host, first(phone ORDER BY CASE WHEN leads THEN 0 ELSE 1 END, CASE WHEN leads THEN -arrival ELSE arrival END) AS phone FROM k WHERE phone <> '' GROUP BY host)
SELECT win.host AS domain, k.provider_id, k.review_count, coalesce(ph.phone, '') AS phone, (SELECT count(*) FROM k x WHERE x.host = win.host)::INTEGER - 1 AS merged
FROM win JOIN k ON k.host = win.host AND k.arrival = win.w LEFT JOIN ph ON ph.host = win.host""")
def dedupe_merge(spark, sf_dir):
    out = dedupe.merge_by_domain(listings(spark, sf_dir), F.col("skip_reason").isNotNull()).where(F.col("skip_reason").isNull())
    return out.select("domain", "provider_id", "review_count", "phone", F.size("also_seen_as").alias("merged"))


@query("SELECT (i * 5 + j)::BIGINT AS tile, 10.9e0 + i * ((11.15e0 - 10.9e0) / 5) AS south, 76.85e0 + j * ((77.1e0 - 76.85e0) / 5) AS west FROM range(5) a(i), range(5) b(j)")
def tile_grid(spark, sf_dir):
    return tiles.tile_grid(spark, 10.9, 11.15, 76.85, 77.1, 5, 5).select("tile", "south", "west")


@query("SELECT (i * 5 + j)::BIGINT AS tile, lower(replace(p_type, ' ', '-')) AS keyword FROM range(5) a(i), range(5) b(j), (SELECT DISTINCT p_type FROM part)")
def tile_keyword_cross(spark, sf_dir):
    words = read(spark, sf_dir, "part").select(strings.slug(F.col("p_type")).alias("keyword")).distinct()
    return tiles.searches(tiles.tile_grid(spark, 10.9, 11.15, 76.85, 77.1, 5, 5), words).select("tile", "keyword")


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN regexp_matches(host, '\.(co|net|org)\.in$|\.co\.uk$') THEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS domain FROM h""")
def registrable_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.registrable(F.col("url")).alias("domain"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|mc_cid|mc_eid)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]$', '') AS href FROM pages""")
def href_normalise(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.clean_href(F.col("url")).alias("href"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS total, count(*) FILTER (starts_with(href, '/')) AS internal, count(DISTINCT href) AS distinct_links FROM a GROUP BY page_id""")
def link_counts(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    links = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    kind = urls.kind(F.col("href"), urls.registrable(F.col("url")))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(kind == "internal").alias("internal"), F.count_distinct("href").alias("distinct_links"))


@query(r"""SELECT page_id, regexp_matches(html, '(?i)this domain (is for sale|has expired)|buy this domain|sedoparking|parkingcrew|bodis|afternic|dan\.com|default web site page|apache2 (ubuntu|debian) default|index of /|<title>\s*(untitled|new page [0-9])')
OR (length(html) < 2048 AND regexp_matches(html, '(?i)coming soon')) OR (length(html) < 512 AND NOT regexp_matches(html, '(?i)<img') AND NOT regexp_matches(html, '(?i)<a\s[^>]*href')) AS parked FROM pages""")
def parked_detect(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", classify.is_parked(F.col("html"), F.length("html")).alias("parked"))


@query("""SELECT page_id, CASE WHEN page_id % 19 = 0 THEN 'robots-disallow' WHEN page_id % 17 = 0 THEN 'probe-error' WHEN page_id % 13 = 0 THEN 'dead-host' WHEN page_id % 11 = 0 THEN 'http-error'
WHEN page_id % 7 = 0 THEN 'redirected-to-facebook.com' WHEN page_id % 5 = 0 THEN 'parked' END AS reason,
CASE WHEN page_id % 19 = 0 OR page_id % 17 = 0 OR page_id % 13 = 0 OR page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 5 = 0 THEN 'skip' ELSE 'audit' END AS verdict FROM pages""")
def verdict_case(spark, sf_dir):
    k = F.col("page_id")
    status = F.when(k % 13 == 0, F.lit(None)).when(k % 11 == 0, 404).otherwise(200).cast("int")
    final = F.when(k % 7 == 0, F.lit("https://www.facebook.com/x")).otherwise(F.col("url"))
    v = classify.verdict(k % 19 != 0, F.when(k % 17 == 0, F.lit("reset")), status, final, F.col("url"), k % 5 == 0)
    return read(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", "v.reason", "v.verdict")


@query(r"""SELECT doc_id, e AS email FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS e FROM documents)""")
def email_extract(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit(strings.EMAIL), F.lit(0)))
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("e")).select("doc_id", strings.email_key(F.col("e")).alias("email")).distinct()


@query(r"""WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '+91 98765-' || (10000 + c_custkey) WHEN 1 THEN '098765' || (10000 + c_custkey) WHEN 2 THEN '98765' || (10000 + c_custkey) ELSE '(0422) 24' || (10000 + c_custkey) END AS v FROM customer),
d AS (SELECT k, v, regexp_replace(v, '[\s\-().+]', '', 'g') AS x FROM p)
SELECT k, CASE WHEN regexp_matches(x, '^(91|0)[0-9]{10}$') THEN right(x, 10) ELSE x END AS phone FROM d""")
def phone_normalise(spark, sf_dir):
    k = F.col("c_custkey")
    tail = (10000 + k).cast("string")
    v = F.when(k % 4 == 0, F.concat(F.lit("+91 98765-"), tail)).when(k % 4 == 1, F.concat(F.lit("098765"), tail)).when(k % 4 == 2, F.concat(F.lit("98765"), tail)).otherwise(F.concat(F.lit("(0422) 24"), tail))
    return read(spark, sf_dir, "customer").select(k.alias("k"), strings.phone_key(v).alias("phone"))


@query("""WITH c AS (SELECT 'site' || (l_suppkey % 50) AS domain, 'phone' AS kind, CAST(l_partkey AS VARCHAR) AS value FROM lineitem),
n AS (SELECT value, count(DISTINCT domain) AS d FROM c GROUP BY value)
SELECT CASE WHEN d > 1 THEN 'agency' WHEN contains('built by 77', value) THEN 'agency' ELSE 'business' END AS owner, count(*) AS contacts FROM c JOIN n USING (value) GROUP BY 1""")
def contact_owner(spark, sf_dir):
    value = F.col("l_partkey").cast("string")
    c = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("site"), (F.col("l_suppkey") % 50).cast("string")).alias("domain"), F.lit("phone").alias("kind"), value.alias("value"), strings.phone_key(value).alias("key"), F.lit("built by 77").alias("credit"))
    return report.contact_owner(c).groupBy("owner").agg(F.count(F.lit(1)).alias("contacts"))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS lead_no, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'agency' || l_suppkey || '.in' END AS credit_domain, s_name AS credit_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT coalesce(credit_domain, lower(credit_name)) AS agency, arg_min(credit_name, lead_no) AS name, count(*) AS built_in_run FROM c GROUP BY 1""")
def agency_table(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    domain = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("agency"), F.col("l_suppkey").cast("string"), F.lit(".in")))
    return report.agency_table(c.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lead_no"), domain.alias("credit_domain"), F.col("s_name").alias("credit_name")))


_FILES = "SELECT l_returnflag AS vertical, l_linestatus AS shot, CAST(l_quantity AS BIGINT) AS src, CAST(l_discount * 100 AS BIGINT) AS out, l_tax = 0 AS error FROM {lineitem}"


@query(f"WITH f AS ({_FILES}) SELECT vertical, shot, grouping(vertical) * 2 + grouping(shot) AS level, count(*) AS files, sum(src)::BIGINT AS src_bytes, sum(out)::BIGINT AS out_bytes, count(*) FILTER (error) AS errors, sum(src)::DOUBLE / CASE WHEN sum(out) = 0 THEN 1 ELSE sum(out)::DOUBLE END AS ratio FROM f GROUP BY GROUPING SETS ((vertical), (shot), ())")
def compress_rollup(spark, sf_dir):
    return report.file_report(view(spark, sf_dir, _FILES))


@query("""WITH n AS (SELECT l_shipmode_proxy AS shot, dims, count(*) AS n FROM (SELECT l_linestatus AS l_shipmode_proxy, CAST(l_quantity AS BIGINT) AS dims FROM lineitem) GROUP BY ALL)
SELECT shot, dims, n, place, greatest(kinds - 4, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY n DESC, dims) AS place, count(*) OVER (PARTITION BY shot) AS kinds FROM n) WHERE place <= 4""")
def topk_dims(spark, sf_dir):
    return report.top_values(read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("shot"), F.col("l_quantity").cast("long").alias("dims")), "shot", "dims")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def review_upsert(spark, sf_dir):
    return report.latest(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query(r"""SELECT page_id, max(TRY_CAST(y AS INTEGER)) AS year FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<footer.*', 0), '(?:19|20)[0-9]{2}')) AS y FROM pages) GROUP BY page_id""")
def copyright_year(spark, sf_dir):
    foot = F.regexp_extract("html", "(?s)<footer.*", 0)
    years = F.explode(F.regexp_extract_all(foot, F.lit("(?:19|20)[0-9]{2}"), F.lit(0)))
    return read(spark, sf_dir, "pages").select("page_id", years.alias("y")).groupBy("page_id").agg(F.max(F.col("y").cast("int")).alias("year"))


@query("SELECT vertical, count(*) AS discovered, count(*) FILTER (has_site) AS with_domain, floor(100e0 * count(*) FILTER (has_site) / count(*) + 0.5e0)::BIGINT AS share FROM (SELECT c_mktsegment AS vertical, c_custkey % 11 <> 0 AS has_site FROM customer) GROUP BY vertical")
def vertical_stats(spark, sf_dir):
    has = F.col("c_custkey") % 11 != 0
    out = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("vertical")).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(has).alias("with_domain"))
    return out.withColumn("share", numbers.percent(F.col("with_domain"), F.col("discovered")))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<meta[^>]*name="viewport"') THEN 'present' ELSE 'missing' END AS viewport,
CASE WHEN regexp_matches(html, '<script[^>]*src="[^"]*jquery') THEN 'present' ELSE 'none' END AS jquery, 'static html' AS generator, CASE WHEN regexp_matches(html, '<form') THEN 'contact form' ELSE 'none' END AS "quoteForm",
CASE WHEN len(regexp_extract_all(html, '(?:src|href|srcset)="http://')) > 0 THEN len(regexp_extract_all(html, '(?:src|href|srcset)="http://')) || ' assets' ELSE 'none' END AS "mixedContent",
len(regexp_extract_all(html, '<img'))::BIGINT AS empty_images, 'none' AS bootstrap, 'none' AS slider, 'none' AS theme, 'none' AS whatsapp FROM pages""")
def html_signals(spark, sf_dir):
    from leadforge.operators.signals import page_signals
    from leadforge.sources.html import html_elements

    out = page_signals(html_elements(read(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    return out.select("page_id", "viewport", "jquery", "generator", "quoteForm", "mixedContent", "empty_images", "bootstrap", "slider", "theme", "whatsapp")


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, 'nav' AS region, count(DISTINCT regexp_replace(href, '#.*$', '')) AS links FROM a GROUP BY page_id""")
def link_region(spark, sf_dir):
    from leadforge.operators.links import links
    from leadforge.sources.html import html_elements

    pages = read(spark, sf_dir, "pages")
    return links(html_elements(pages, "page_id", "html"), pages, "page_id").groupBy("page_id", "region").agg(F.count(F.lit(1)).alias("links"))


@query("""SELECT host, agent_bytes, allowed FROM (SELECT DISTINCT 'h' || (page_id % 7) AS host, (page_id % 7)::BIGINT AS agent_bytes, (page_id % 7) <> 3 AS allowed FROM pages)""")
def robots_longest_match(spark, sf_dir):
    from leadforge.operators.robots import robots_rules

    k = F.col("page_id") % 7
    body = F.when(k == 3, F.lit("User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /\n\nUser-agent: other\nDisallow: /")).otherwise(F.lit("User-agent: *\n\nDisallow: /private # no\nAllow: /x/y\nDisallow: /x/y"))
    hosts = read(spark, sf_dir, "pages").select(F.concat(F.lit("h"), k.cast("string")).alias("host"), k.alias("agent_bytes"), body.alias("body")).distinct()
    rules = robots_rules(hosts, "leadbot")
    return hosts.join(rules, "host").select("host", "agent_bytes", classify.robots_allowed(F.lit("/x/y/z"), F.col("allow"), F.col("disallow")).alias("allowed"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'blocked-429' WHEN 1 THEN 'dns' WHEN 2 THEN 'nav-timeout' WHEN 3 THEN 'crash' ELSE 'unknown' END AS kind, event_id % 5 IN (0, 2, 3) AS retry FROM events")
def error_kinds(spark, sf_dir):
    k = F.col("event_id") % 5
    message = F.when(k == 1, "net::ERR_NAME_NOT_RESOLVED at x").when(k == 2, "Timeout 30000ms exceeded").when(k == 3, "Target closed").otherwise("odd")
    kind = classify.error_kind(message, F.when(k == 0, 429))
    return read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), kind.isin(*classify.RETRYABLE).alias("retry"))


@query("SELECT o_orderkey, sum(l_quantity::BIGINT)::BIGINT AS transfer, coalesce(sum(l_quantity::BIGINT) FILTER (l_linestatus = 'O'), 0)::BIGINT AS images FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def asset_sums(spark, sf_dir):
    from leadforge.operators.captures import asset_bytes

    assets = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.array(F.struct(F.col("l_linestatus").alias("type"), F.col("l_quantity").cast("bigint").alias("bytes"))).alias("assets"))
    sums = assets.groupBy("o_orderkey").agg(F.sum(asset_bytes(F.col("assets"))).alias("transfer"), F.sum(asset_bytes(F.col("assets"), "O")).alias("images"))
    return sums.join(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("SELECT p_partkey, floor(p_size * 100 * least(1e0, 720e0 / (p_size * 100)) + 0.5e0)::BIGINT AS width, least(floor(p_retailprice * least(1e0, 720e0 / (p_size * 100)) + 0.5e0)::BIGINT, 16000) AS height FROM part")
def shot_geometry(spark, sf_dir):
    from leadforge.operators.captures import scaled

    return read(spark, sf_dir, "part").select("p_partkey", scaled(F.col("p_size") * 100, F.col("p_retailprice")).alias("g")).select("p_partkey", "g.width", "g.height")


@query("SELECT event_id, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1.5, false) AS too_soon FROM events")
def host_spacing(spark, sf_dir):
    from leadforge.operators.captures import spacing

    return spacing(read(spark, sf_dir, "events"), "user_id", "ts", 1.5).select("event_id", "too_soon")


@query("""SELECT count(*) AS total, count(*) FILTER (page_id % 11 <> 0) AS with_domain, count(*) FILTER (page_id % 3 = 0) AS qualified, count(*) FILTER (page_id % 3 <> 0) AS skipped,
count(*) FILTER (page_id % 4 = 1) AS mobile_broken, count(*) FILTER (page_id % 5 = 0) AS expired FROM pages""")
def qualify_summary(spark, sf_dir):
    from leadforge.operators.captures import qualify_summary as summary

    k = F.col("page_id")
    return summary(read(spark, sf_dir, "pages").select(F.when(k % 11 != 0, F.lit("a.in")).alias("domain"), F.when(k % 3 == 0, "audit").otherwise("skip").alias("verdict"), F.when(k % 4 == 1, False).when(k % 4 == 2, True).alias("viewport_meta"), F.when(k % 5 == 0, "expired 2024-01").otherwise("ok").alias("https")))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 3) = 3 AS complete FROM lineitem GROUP BY l_orderkey")
def capture_complete(spark, sf_dir):
    from leadforge.operators.captures import complete

    return complete(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("file")), "l_orderkey", ("1", "2", "3"))


@query("SELECT DISTINCT 'd' || l_partkey % 500 AS domain FROM lineitem WHERE l_partkey % 500 <> l_suppkey AND l_partkey % 500 NOT IN (SELECT s_suppkey FROM supplier)")
def portfolio_expansion(spark, sf_dir):
    from leadforge.operators.captures import expansion

    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    links = read(spark, sf_dir, "lineitem").select(name(F.col("l_suppkey")).alias("domain"), name(F.col("l_partkey") % 500).alias("target"))
    return expansion(links, read(spark, sf_dir, "supplier").select(name(F.col("s_suppkey")).alias("domain")))


@query("SELECT s_suppkey, substr(sha256(s_name || CAST(s_nationkey AS VARCHAR)), 1, 16) AS config_hash FROM supplier")
def config_hash(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", strings.config_hash(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("config_hash"))


@query("SELECT p_partkey, 'Plan ' || p_size || ' for Rs. ' || p_size || ',000' AS text, CAST(p_size AS VARCHAR) || '000' AS price FROM part")
def price_extract(spark, sf_dir):
    from leadforge.operators.captures import prices

    text = F.concat(F.lit("Plan "), F.col("p_size").cast("string"), F.lit(" for Rs. "), F.col("p_size").cast("string"), F.lit(",000"))
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.array_join(prices(text), ",").alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'element' WHEN o_orderkey % 3 = 0 THEN 'structured' WHEN o_orderkey % 2 = 0 THEN '12 Some Street, Town 641 001' WHEN o_orderkey % 7 = 0 THEN 'provider' ELSE 'none' END AS address FROM orders")
def address_cascade(spark, sf_dir):
    from leadforge.operators.captures import address

    k = F.col("o_orderkey")
    body = F.when(k % 2 == 0, F.lit("Call us\n12 Some Street, Town 641 001\nbye"))
    out = address(F.when(k % 5 == 0, F.lit(" element ")), F.when(k % 3 == 0, F.lit("structured")), body, F.when(k % 7 == 0, F.lit("provider")))
    return read(spark, sf_dir, "orders").select("o_orderkey", out.alias("address"))
