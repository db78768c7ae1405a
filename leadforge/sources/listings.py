"""Recorded provider answers: ``<vertical>-tile<N>-<keyword>.json`` files, and tolerant JSON columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("provider_id", "name", "website_raw")), T.StructField("rating", T.DoubleType()), T.StructField("review_count", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("address", "phone")), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()),
    *(T.StructField(n, T.StringType()) for n in ("business_status", "primary_type")),
])


def recorded_listings(spark: SparkSession, folder: str, vertical: str) -> DataFrame:
    """Rows of all recorded answers of a vertical with vertical, tile, keyword; a tile without a file has no rows."""
    df = spark.read.schema(LISTING).option("multiLine", True).option("pathGlobFilter", f"{vertical}-tile*.json").json(folder)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return df.select("*", F.lit(vertical).alias("vertical"), F.regexp_extract(name, r"-tile([0-9]+)-", 1).cast("int").alias("tile"), F.regexp_extract(name, r"-tile[0-9]+-(.*)\.json$", 1).alias("keyword"))


def tolerant(text: Column, schema: str) -> Column:
    """A JSON column; null where it is missing or malformed."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def stage_rows(spark: SparkSession, root: str, vertical: str | None = None) -> DataFrame:
    """A stage's table under ``root``, partitioned by vertical; one vertical prunes to its folder."""
    df = spark.read.parquet(root)
    return df if vertical is None else df.where(F.col("vertical") == vertical)


def first_of(spark: SparkSession, places: list[tuple[str, str]]) -> DataFrame:
    """The first of the named Parquet tables that can be read, with its name in ``source``; the last one is made-up data and marked as ``synthetic``."""
    for name, path in places:
        try:
            df = spark.read.parquet(path)
        except AnalysisException:  # no such table, or none that says what its columns are
            continue
        return df.withColumns({"source": F.lit(name), "synthetic": F.lit(name == places[-1][0])})
    raise ValueError("none of the sources can be read")


def images(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(vertical, domain, shot, path, bytes) of screenshots under vertical/domain/shot.ext, the first ``most`` by path; empty files are ignored."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0").select("path", F.col("length").alias("bytes"))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    df = df.where(F.col("path").rlike(r"(?i)\.(png|jpe?g|webp)$")).select(part(-3).alias("vertical"), part(-2).alias("domain"), F.regexp_replace(part(-1), r"\.[^.]+$", "").alias("shot"), "path", "bytes")
    return df if most is None else df.orderBy("path").limit(most)
