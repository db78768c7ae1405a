"""Incremental stages: each run does the files that have come since the one before, and nothing else.

A stage's input is a folder of JSON files that only grows. Its progress is the stream's checkpoint: a run reads the files that no run has
committed, adds the worked rows to the stage's table and stops; a run that was cut off begins its batch again, and the table takes it once.
Rows that are done already (the caller says which) pass through as they are, beside the worked ones, so a table holds all rows of its files;
:func:`in_first_order` reads them in the order of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumed(rows: DataFrame, done: Column, work: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """``rows`` in which those that are not ``done`` have the columns that ``work`` computes; a null counts as not done. One pass, so a stream is read once."""
    finished = F.coalesce(done, F.lit(False))
    return rows.withColumns({c: F.when(finished, rows[c]).otherwise(new) if c in rows.columns else F.when(~finished, new) for c, new in work(rows).items()})


def run_stage(
    spark: SparkSession, source: str, schema: str, done: Column, work: Callable[[DataFrame], dict[str, Column]], table: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Works through the new files of ``source`` and stops. The table knows of every row which file it came from."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    rows = rows.withColumn("input_file", F.col("_metadata.file_name"))
    out = resumed(rows, done, work)
    return out.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_first_order(spark: SparkSession, table: str, *order: str) -> DataFrame:
    """A stage's rows, passed through and worked, in the order of the input."""
    return spark.read.parquet(table).orderBy(*order)


def rows_read(query: StreamingQuery) -> int:
    """Rows that a run has read."""
    return sum(p["numInputRows"] for p in query.recentProgress)
