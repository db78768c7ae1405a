"""Mixing sources to target weights along a time-varying curriculum.

Targets: a share of all words is dealt to sources by weight, none above a multiple of its own
words, the excess reshared by weight (the water level is found in closed form over the sorted
ratios of limit and weight). Within a source, documents stand in a fixed pseudo-random order; the mix reads that stream from the
start, and again, until the target is met. Curriculum: a source's weight schedule over training
time t in [0, 1] is linear, ``begin + (end - begin) * t`` with mean 1; its integral is the share of
the target demanded by time t, so inverting it gives every document its training position, by
which documents are range-sorted. A table that is read again comes in any order of its files, so
the last stage of the pipeline takes every reading's place from the stored mix.

What the mix takes from a document is what its readings take; a reading that the target cuts to less than half of
the document has words but no position of its own, since whole documents are read.

Running sums are taken in two levels, over buckets of the order key and within a bucket, so that a
source with a third of all rows is spread over 4,096 tasks' worth of rows. One row per source passes a single-task window.

Defined cases: null texts have no words and are never taken; a null source is a source of its own
and sorts last; ties in the order key are broken by size; if no text has words all targets are 0;
empty tables give empty results. New columns start with ``mix_``; a table that has one of their names is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.llm.common import n_words, small, stored

WEIGHTS = (5, 2, 1)
#: Schedule (begin, end) of the sources of each weight: heavy sources early, light ones late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUCKET_DIGITS = 3
#: Columns that are made, for a while or to stay.
MADE = frozenset(f"mix_{x}" for x in "source size order bucket s b before source_size target weight_no within start taken positions reading position place".split())


def order_key(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, share_percent: int = 150, limit: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """mix_source, source_size, weight_no, target from rows (mix_source, mix_size)."""
    named = W.orderBy(F.col("mix_source").isNull(), "mix_source")
    by_level = W.orderBy("ratio", F.col("mix_source").isNull(), "mix_source")
    after, before = by_level.rowsBetween(0, W.unboundedFollowing), by_level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    s = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    s = s.withColumn("weight_no", F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("weight_no") + 1).cast("long"))
    s = s.withColumn("most", limit * F.col("source_size")).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    s = s.withColumn("open", F.sum("source_size").over(whole) * share_percent / 100.0 - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(after))
    fits = F.when(F.col("open") * F.col("weight") / F.col("rest") <= F.col("most"), F.struct("ratio", F.col("mix_source").isNull(), "mix_source", "open", "rest"))
    s = s.withColumn("level", F.min(fits).over(whole))
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("level.open") * F.col("weight") / F.col("level.rest")))
    return s.select("mix_source", "source_size", "weight_no", target.alias("target"))


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share_percent: int = 150, limit: int = 2) -> DataFrame:
    """``df`` with mix_size, mix_source_size, mix_target, mix_start (words before it in its source's stream), mix_weight_no,
    mix_positions (of its first and second reading, null for one that does not count) and mix_taken (words of both)."""
    if clash := sorted(c for c in df.columns if c.lower() in MADE):
        raise ValueError(f"the table has columns that mixing makes: {', '.join(clash)}")
    sized = df.withColumns({"mix_source": df[source], "mix_size": n_words(df[text]), "mix_order": order_key(df[key])})
    sized = sized.withColumn("mix_bucket", F.substring("mix_order", 1, BUCKET_DIGITS))
    buckets = stored(sized.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("mix_size")), "buckets")
    targets = source_targets(buckets, share_percent, limit)
    past = W.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("mix_size").over(past), F.lit(0))).join(targets.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")))
    offsets = stored(offsets.select(F.col("mix_source").alias("mix_s"), F.col("mix_bucket").alias("mix_b"), F.col("before").alias("mix_before"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("weight_no").alias("mix_weight_no")), "offsets")
    inner = W.partitionBy("mix_source", "mix_bucket").orderBy("mix_order", "mix_size").rowsBetween(W.unboundedPreceding, -1)
    out = sized.withColumn("mix_within", F.coalesce(F.sum("mix_size").over(inner), F.lit(0)))
    # at most 4,096 rows for each source: broadcast up to a counted size, so that texts don't move for it
    out = out.join(small(offsets), F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_bucket") == F.col("mix_b")))
    out = out.withColumn("mix_start", F.col("mix_before") + F.col("mix_within"))
    counts = [F.when((taken(k) > 0) & (2 * taken(k) >= F.col("mix_size")), position(F.lit(k))) for k in (0, 1)]
    out = out.withColumns({"mix_positions": F.array(*counts), "mix_taken": taken(0) + taken(1)})
    return out.drop("mix_s", "mix_b", "mix_before", "mix_within", "mix_order", "mix_bucket", "mix_source")


def taken(repeat: int) -> Column:
    """Words that the mix takes from a document at its source's first (0) or second (1) reading."""
    room = F.floor(F.col("mix_target") + 0.5) - repeat * F.col("mix_source_size") - F.col("mix_start")
    return F.greatest(F.lit(0), F.least(room, F.col("mix_size"))).cast("long")


def position(repeat: Column) -> Column:
    """Training time in [0, 1] of a document's reading: its source's integrated schedule, inverted."""
    y = F.least(F.lit(1.0), (F.col("mix_start") + F.col("mix_size") / 2 + repeat * F.col("mix_source_size")) / F.col("mix_target"))
    out = y
    for i, (begin, end) in enumerate(SCHEDULES):
        turned = y / begin if begin == end else (F.sqrt(F.greatest(F.lit(0.0), begin**2 + 2 * (end - begin) * y)) - begin) / (end - begin)
        out = F.when(F.col("mix_weight_no") == i, turned).otherwise(out)
    return out


def readings(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The columns of :func:`assign`, with mix_reading and mix_position: a row for every reading, range-sorted by training position.

    A reading counts when at least half of its words lie below the target. Equal positions are ordered by the key's order and the reading.
    """
    out = assign(df, key, text, source)
    out = out.select("*", F.posexplode("mix_positions").alias("mix_reading", "mix_position")).where(F.col("mix_position").isNotNull())
    return in_order(out, key, ["mix_position"], ["mix_reading"])


def in_order(df: DataFrame, key: str, first: list, last: list) -> DataFrame:
    """``df`` range-sorted by ``first``, then the key's order, then ``last``."""
    order = [*first, "mix_order", *last]
    return df.withColumn("mix_order", order_key(df[key])).repartitionByRange(*order).sortWithinPartitions(*order).drop("mix_order")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: whole rows of ``df``, read once or twice or not at all, sorted by training position."""
    return readings(df, key, text, source).select(*df.columns)


def placed(mix: DataFrame) -> DataFrame:
    """``mix`` with mix_place, which grows along the mix and does not depend on the order in which its files are read.

    The place is the number of the row's part file (files are written in the order of the sorted partitions) and its row within that file.
    A mix that is not a stored table becomes one first.
    """
    if mix._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        mix = stored(mix, "mix")
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    return mix.withColumn("mix_place", F.shiftleft(part, 33) + F.col("_metadata.row_index"))
