"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadforge.llm.common import stored
from leadforge.llm.exact import drop_copies
from leadforge.llm.mixing import mixed, placed
from leadforge.llm.ngrams import drop_similar
from leadforge.llm.pieces import encoded
from leadforge.llm.quality import quality_filter


def _narrow(spark: SparkSession) -> None:
    """Whole texts pass through every stage, so fewer rows are held at once where the session says nothing else: batches of the
    Parquet reader (default 4,096 rows, which one long text makes large) and row groups of the writer (default 128 MB a task)."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) == 4096:
        spark.conf.set(name, 256)
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", 16 << 20)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    _narrow(spark)
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _narrow(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return drop_similar(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, read as often as their source's target asks."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every reading, and its place in training order."""
    out = encoded(placed(docs), outputs=("ids",), carry="mix_place").withColumnRenamed("mix_place", "place")
    return out.select("doc_id", "place", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("n-gram join", near_dedup), ("mixing", mixing), ("encoding", encoding)]
#: SQL cannot express the similarity components and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
