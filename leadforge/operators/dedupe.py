"""Business listings: first by provider id, then one row per registrable domain.

The merge by domain is a fold in arrival order. In closed form: a row leads if its reviews exceed
all earlier ones of its domain; the last leader wins and gives every field but phone and address,
which come from the first non-empty value over leaders from last to first and then the others by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row of each key by ``order``; rows without a key are dropped."""
    w = W.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merge_by_domain(df: DataFrame, exempt: Column, domain: str = "domain", ident: str = "provider_id", arrival: str = "arrival", reviews: str = "review_count") -> DataFrame:
    """One row per domain with ``also_seen_as``; rows where ``exempt`` holds or the domain is null stay as they are."""
    apart = F.coalesce(exempt | F.col(domain).isNull(), F.lit(False))
    forth, back = W.partitionBy(domain).orderBy(arrival), W.partitionBy(domain).orderBy(F.desc(arrival))
    r = F.coalesce(F.col(reviews), F.lit(0))
    # running frames that grow from one end: linear in a domain's rows
    before = F.max(r).over(forth.rowsBetween(W.unboundedPreceding, -1))
    marked = df.where(~apart).withColumn("_lead", before.isNull() | (r > before))
    marked = marked.withColumn("_next", F.min(F.when(F.col("_lead"), F.col(arrival))).over(back.rowsBetween(W.unboundedPreceding, -1)))
    gone = F.when(F.col("_lead"), F.col("_next")).otherwise(F.col(arrival))
    order = F.struct(F.when(F.col("_lead"), 0).otherwise(1), F.when(F.col("_lead"), -F.col(arrival)).otherwise(F.col(arrival)))
    filled = [c for c in ("phone", "address") if c in df.columns]
    out = marked.groupBy(domain).agg(
        F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.when(F.col("_lead"), F.col(arrival))).alias("_row"),
        *(F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), order)).alias(f"_{c}") for c in filled),
        F.sort_array(F.collect_list(F.when(gone.isNotNull(), F.struct(gone.alias("at"), F.col(ident).alias("who"))))).alias("_seen"),
    )
    fields = [F.coalesce(f"_{c}", F.col(f"_row.{c}")).alias(c) if c in filled else F.col(f"_row.{c}").alias(c) for c in df.columns]
    merged = out.select(*fields, F.transform("_seen", lambda x: x["who"]).alias("also_seen_as"))
    rest = df.where(apart).withColumn("also_seen_as", F.array().cast(merged.schema["also_seen_as"].dataType))
    return merged.unionByName(rest)
