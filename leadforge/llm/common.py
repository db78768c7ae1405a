"""Shared pieces of the training-data operators: tables, shared scratch space, grouped streaming."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space, tab, LF, VT, FF, CR (a Java and RE2 regular expression).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: This program's part of the shared folder.
SCRATCH = f"leadforge-{uuid.uuid4().hex}"
#: Rows of an Arrow batch: some 3 MB of documents in a task instead of 30.
BATCH_ROWS = 1000
#: Rows of keys up to which :func:`without` broadcasts them (some 60 MB); beyond, rows are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is higher: what Python workers and Arrow hold beside the heap goes with it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder, and a cluster an error: no other folder is known to be shared there."""
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="leadforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{SCRATCH}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes what this program has stored in the shared folder; tables that were read from it can't be read any more."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        remove(spark, f"{root.rstrip('/')}/{SCRATCH}")


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of stored tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "stage", folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder (a new part of it, or ``folder``) and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A stored table, marked for broadcast if it has no more rows than ``most``; else the planner joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def without(df: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``gone``, a stored table; ``keys`` gives each of its columns as a column of ``df``. Null keys match null."""
    right = gone.select(*(F.col(c).alias(f"__gone_{c}") for c in keys))
    right = small(right)
    same = [value.eqNullSafe(right[f"__gone_{c}"]) for c, value in keys.items()]
    return df.join(right, same, "left_anti").select(*(df[c] for c in df.columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row (a one-element transform binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches in which the rows of a group follow one another; holds one group at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        starts = change.nonzero()[0].tolist()
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            part = pdf.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
