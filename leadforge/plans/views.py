"""Lead relations over the driver's tables. One text per view, which both Spark and DuckDB read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = 2026
TABLES = ("customer", "orders", "labels", "lineitem", "supplier", "part", "events", "pages", "documents")

LEADS = """
SELECT c.c_custkey AS k, c.c_name AS name, c.c_mktsegment AS vertical,
  'site' || CAST(c.c_custkey AS STRING) || CASE c.c_custkey % 3 WHEN 0 THEN '.co.in' WHEN 1 THEN '.com' ELSE '.in' END AS domain,
  1 + 4 * (c.c_acctbal + 1000) / 11000 AS rating, coalesce(o.n, 0) * 5 AS reviews, c.c_custkey % 7 AS dead_links, c.c_custkey % 4 = 0 AS agency,
  c.c_custkey % 2 = 0 AS has_phone, c.c_custkey % 3 = 0 AS has_email, c.c_custkey % 5 = 0 AS has_instagram,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'none' ELSE CAST(2008 + c.c_custkey % 18 AS STRING) END AS copyright,
  CASE c.c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN '1.12.4' WHEN 2 THEN '3.6.0' WHEN 3 THEN 'present' ELSE '2.2.4' END AS jquery,
  CASE c.c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN '3.3.7' WHEN 2 THEN '5.1.0' ELSE 'present' END AS bootstrap,
  CASE c.c_custkey % 6 WHEN 0 THEN 'RevSlider 5.4' WHEN 1 THEN 'swiper 8.0' WHEN 2 THEN 'owl carousel' ELSE 'none' END AS slider,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'none' ELSE CAST(2005 + c.c_custkey % 17 AS STRING) END AS wayback,
  CASE c.c_custkey % 6 WHEN 0 THEN 'never' WHEN 1 THEN 'n/a' ELSE CAST(2010 + c.c_custkey % 14 AS STRING) END AS redesigned,
  CASE c.c_custkey % 7 WHEN 0 THEN 'WordPress 4.9' WHEN 1 THEN 'WordPress 6.2' WHEN 2 THEN 'Wix' WHEN 3 THEN 'static html' WHEN 4 THEN 'FrontPage 4.0' ELSE 'none' END AS generator,
  CASE WHEN c.c_custkey % 9 = 0 THEN 'builder default' ELSE 'none' END AS theme,
  CASE WHEN c.c_custkey % 8 = 0 THEN '0 mo' ELSE CAST(c.c_custkey % 16 AS STRING) || ' yr' END AS domainAge,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'missing' ELSE 'present' END AS viewport,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'none' ELSE '+' || CAST(c.c_custkey * 7 % 400 AS STRING) || 'px' END AS overflow,
  CAST(c.c_custkey % 31 AS STRING) || ' under 44px' AS tapTargets,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'none' ELSE CAST(c.c_custkey % 9 AS STRING) || '.' || CAST(c.c_custkey % 10 AS STRING) || 's' END AS lcp,
  CAST(c.c_custkey % 13 AS STRING) || '.' || CAST(c.c_custkey % 10 AS STRING) || ' MB' AS pageWeight,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'hero.mp4 4 MB autoplay' ELSE 'none' END AS heroVideo,
  CASE c.c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'expired 2023-04' ELSE 'ok' END AS https,
  CASE WHEN c.c_custkey % 4 = 0 THEN CAST(c.c_custkey % 9 AS STRING) || ' assets' ELSE 'none' END AS mixedContent,
  CASE WHEN c.c_custkey % 3 = 0 THEN CAST(c.c_custkey % 8 AS STRING) || ' broken' ELSE 'none' END AS brokenImages,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'float' ELSE 'none' END AS whatsapp,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'none' ELSE 'generic form' END AS quoteForm,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'none' ELSE CAST(2012 + c.c_custkey % 13 AS STRING) END AS blog
FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

#: Listings: several orders of a customer are listings of one business.
LISTINGS = """
SELECT o_orderkey AS provider_id, o_orderkey AS arrival, o_custkey % 97 AS review_count,
  CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN 'https://www.facebook.com/p' || CAST(o_custkey AS STRING)
    WHEN o_custkey % 17 = 0 THEN 'http://www.99acres.com/' || CAST(o_custkey AS STRING) ELSE 'https://www.shop' || CAST(o_custkey AS STRING) || '.co.in/' END AS website,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '98765' || CAST(10000 + o_orderkey % 1000 AS STRING) END AS phone, CAST(o_totalprice AS STRING) AS address, o_orderpriority AS keyword
FROM {orders}
"""

#: Human marks of leads.
REVIEWS = """
SELECT doc_id AS k, CASE quality * 2 + toxic WHEN 0 THEN 'C' WHEN 1 THEN 'X' WHEN 2 THEN 'A' ELSE 'B' END AS human_tier, quality = 1 AS pitch FROM {labels}
"""


#: Rows for each task where much is made of a row.
SPREAD_ROWS = 2_000


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt over as many tasks as its rows deserve: a few MB are one task of a scan, whatever is made of each row after it."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(most, -(-df.count() // SPREAD_ROWS))), by)


def view(spark: SparkSession, sf_dir: str, sql: str, spread_by: str | None = None) -> DataFrame:
    """A text over the tables; with ``spread_by``, a column of each, their rows are dealt over many tasks before."""
    names = [n for n in TABLES if "{" + n + "}" in sql]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **{n: spread(t, spread_by) if spread_by else t for n, t in tables.items()})


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    for n in TABLES:
        sql = sql.replace("{" + n + "}", n)
    return sql


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_compact(F.array(*(F.when(F.col(f"has_{k}"), F.lit(k)) for k in ("phone", "email", "instagram"))))
    return view(spark, sf_dir, LEADS).withColumn("kinds", kinds)
