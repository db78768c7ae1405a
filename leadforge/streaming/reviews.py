"""Review marks as a stream: every batch upserts the latest mark of each domain into a versioned table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leadforge.operators.report import latest, upsert

MARKS = "domain string, human_tier string, pitch boolean, note string, reviewed_at string, seq bigint"


#: Complete versions that stay, for readers of the one before.
KEPT = 2


def versions(spark: SparkSession, table: str) -> list[str]:
    """Names of the complete versions, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in store.listStatus(hadoop) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if store.exists(hadoop) else []
    return sorted(done)


def current(spark: SparkSession, table: str) -> DataFrame:
    """Latest version of the table, empty before the first batch."""
    done = versions(spark, table)
    return spark.read.schema(MARKS).parquet(f"{table}/{done[-1]}") if done else spark.createDataFrame([], MARKS)


def upsert_marks(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Reads new JSON files of marks once and merges them.

    Versions go on from the table's last one, whatever checkpoint a stream starts from; a batch that runs again after its version is complete changes nothing.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, number: int) -> None:
        done = versions(spark, table)
        mark = f"-{run}-{number:012d}"
        if any(name.endswith(mark) for name in done):
            return
        following = int(done[-1][1:13]) + 1 if done else 0
        upsert(current(spark, table), latest(batch, "domain", "reviewed_at", "seq"), "domain").write.mode("overwrite").parquet(f"{table}/v{following:012d}{mark}")
        for name in done[: 1 - KEPT]:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{name}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return spark.readStream.schema(MARKS).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
