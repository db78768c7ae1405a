"""Columns and aggregates over capture metadata: assets, headers, completeness, geometry, spacing, prices, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.functions.numbers import half_up


def asset_bytes(assets: Column, *kinds: str) -> Column:
    """Bytes of the assets (array of struct(type, bytes)) of some kinds, or of all."""
    chosen = F.filter(assets, lambda a: a["type"].isin(*kinds)) if kinds else assets
    return F.aggregate(F.coalesce(chosen, F.array().cast("array<struct<type:string,bytes:bigint>>")), F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["bytes"], F.lit(0)))


def plain_headers(headers: Column) -> Column:
    """Response headers without cookies."""
    return F.map_filter(headers, lambda k, _: F.lower(k) != "set-cookie")


def complete(files: DataFrame, key: str, needed: tuple[str, ...]) -> DataFrame:
    """(key, complete): whether all needed files of a capture exist."""
    return files.groupBy(key).agg((F.count_distinct(F.when(F.col("file").isin(*needed), F.col("file"))) == len(needed)).alias("complete"))


def scaled(width: Column, height: Column, most: int = 720, cap: int = 16000) -> Column:
    """struct(width, height) of a picture shrunk to a width, its height capped."""
    scale = F.least(F.lit(1.0), most / width)
    return F.struct(half_up(width * scale).alias("width"), F.least(half_up(height * scale), F.lit(cap)).alias("height"))


def spacing(events: DataFrame, key: str, at: str, least_seconds: float) -> DataFrame:
    """``events`` with the seconds since the one before on the same key, and whether that is too soon."""
    w = W.partitionBy(key).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(w)
    return events.withColumns({"gap": gap, "too_soon": F.coalesce(gap < least_seconds, F.lit(False))})


def qualify_summary(sites: DataFrame) -> DataFrame:
    """Totals over sites (domain, verdict, viewport_meta, https): an unknown viewport is not a missing one."""
    return sites.agg(
        F.count(F.lit(1)).alias("total"), F.count("domain").alias("with_domain"), F.count_if(F.col("verdict") == "audit").alias("qualified"), F.count_if(F.col("verdict") == "skip").alias("skipped"),
        F.count_if(F.col("viewport_meta") == F.lit(False)).alias("mobile_broken"), F.count_if(F.col("https").startswith("expired")).alias("expired"),
    )


def prices(text: Column) -> Column:
    """Distinct amounts after a currency mark, in text order, without separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:₹|rs\.?|inr)\s*([0-9][0-9,]*)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def address(element: Column, structured: Column, body: Column, provider: Column) -> Column:
    """First of: the address element, structured data, a line that ends in a six-digit code, the provider's."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    coded = F.regexp_extract(F.coalesce(body, F.lit("")), r"([^\n]{10,120}\b[1-9][0-9]{2} ?[0-9]{3})\b", 1)
    return F.coalesce(clean(element), clean(structured), clean(coded), clean(provider), F.lit("none"))


def expansion(links: DataFrame, known: DataFrame, own: str = "domain", target: str = "target") -> DataFrame:
    """Portfolio domains that agencies link to and the run does not know yet."""
    return links.where(F.col(target).isNotNull() & (F.col(target) != F.col(own))).select(F.col(target).alias(own)).distinct().join(known.select(own).distinct(), own, "left_anti")
