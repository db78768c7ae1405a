"""Sinks: partitioned stage tables, quoted CSV with BOM and CRLF, dead letters, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadforge.functions.strings import csv_cell


def write_stage(df: DataFrame, root: str) -> None:
    """One folder per vertical; only the verticals in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vertical").parquet(root)


def document_head(businesses: DataFrame, run_id: str, source: str, queried_at: str) -> DataFrame:
    """What a discovery says about itself, a row for each vertical, from (vertical, tile, keyword, domain, skip_reason)."""
    portal = F.col("skip_reason") == "aggregator-profile-only"
    return businesses.groupBy("vertical").agg(
        F.lit(run_id).alias("run"), F.lit(source).alias("source"), F.lit(queried_at).alias("queried_at"), F.count_distinct("tile").alias("tiles"), F.count_distinct("keyword").alias("keywords"),
        F.count(F.lit(1)).alias("raw_results"), F.count("domain").alias("with_domain"), F.count_if(portal).alias("greenfield"),
    )


def write_document(rows: DataFrame, head: DataFrame, root: str) -> None:
    """A stage's rows and their head (columns with vertical in both), each a table partitioned by vertical; verticals that are not in them stay as they were.

    The head is written last: a run that dies between the two leaves the head of the run before, by which it is seen.
    """
    write_stage(rows, f"{root}/rows")
    write_stage(head, f"{root}/head")


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """One file, every cell quoted, CRLF ends, U+FEFF before the header: the form spreadsheet programs expect."""
    lines = df.withColumn("_line", F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns))).withColumn("_part", F.lit(1))
    head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    title = df.sparkSession.range(1).select(F.lit(head).alias("_line"), F.lit(0).alias("_part"))
    every = title.unionByName(lines.select("_line", "_part", *order), allowMissingColumns=True)
    # all work before the file runs in parallel; a single file is written by a single task
    every.repartition(1).sortWithinPartitions("_part", *order).select("_line").write.mode("overwrite").text(path, lineSep="\r\n")


def split_errors(df: DataFrame, error: Column, stage: str) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and dead letters (domain, stage, error) of the others."""
    marked = df.withColumn("_error", error)
    return marked.where("_error is null").drop("_error"), marked.where("_error is not null").select("domain", F.lit(stage).alias("stage"), F.substring("_error", 1, 200).alias("error"))


def log_run(counts: DataFrame, path: str) -> None:
    counts.write.mode("append").parquet(path)
