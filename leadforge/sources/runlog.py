"""Stages that count what they write: ok, error and skipped rows are counted while the stage's one job writes them, then a line goes to the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, stage string, n_rows bigint, ok bigint, errors bigint, skipped bigint"


def write_counted(df: DataFrame, path: str, stage: str, run_id: str, log: str, error: Column, skipped: Column) -> dict[str, int]:
    """Writes ``df`` as Parquet and appends its counts to the log. An error counts as such even if the row was skipped; null conditions do not hold."""
    failed, left = F.coalesce(error, F.lit(False)), F.coalesce(skipped, F.lit(False))
    counts = Observation(f"{stage} {run_id}")
    seen = df.observe(
        counts, F.count(F.lit(1)).alias("n_rows"), F.count_if(~failed & ~left).alias("ok"), F.count_if(failed).alias("errors"), F.count_if(left & ~failed).alias("skipped")
    )
    seen.write.mode("overwrite").parquet(path)
    found = {c: int(counts.get[c]) for c in ("n_rows", "ok", "errors", "skipped")}
    df.sparkSession.createDataFrame([(run_id, stage, *found.values())], LOG).coalesce(1).write.mode("append").parquet(log)
    return found


def run_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)
