"""Start times of requests that keep a distance: each begins when it arrives, or ``gap`` after the one before on its host, whichever is later.

The rule start[i] = max(arrival[i], start[i - 1] + gap) has the closed form start[i] = i gap + max over j <= i of (arrival[j] - j gap), a running maximum. It is taken in two levels:
within blocks of a host's time, and over the blocks' maxima, so a host that has most requests is many tasks' work. Times are whole microseconds.
Requests of a host that arrive together start in order of ``tie``. Requests without a time have no start; a null host is a host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def start_times(requests: DataFrame, host: str | None, at: str, tie: str, gap_seconds: float, block_seconds: int = 3600) -> DataFrame:
    """``requests`` with ``start`` (a timestamp) and ``waited`` (seconds); without ``host`` all share one line. A block is what arrives at a host in ``block_seconds``."""
    gap = round(gap_seconds * MICROS)
    line = requests[host] if host is not None else F.lit("all")
    rows = requests.withColumns({"_line": line, "_at": F.unix_micros(requests[at].cast("timestamp"))})
    rows = rows.withColumn("_block", F.floor(F.col("_at") / (block_seconds * MICROS)))
    inside = Window.partitionBy("_line", "_block").orderBy("_at", tie)
    rows = rows.withColumn("_i", F.row_number().over(inside) - 1)
    rows = rows.withColumn("_most", F.max(F.col("_at") - F.col("_i") * gap).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each block: how many requests came before it, and the greatest of what they leave
    blocks = rows.groupBy("_line", "_block").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("_at") - F.col("_i") * gap).alias("_top"))
    earlier = Window.partitionBy("_line").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_carried", F.max(F.col("_top") - F.col("_before") * gap).over(earlier))
    blocks = blocks.select(F.col("_line").alias("_l"), F.col("_block").alias("_b"), "_before", "_carried")
    joined = rows.join(blocks, rows["_line"].eqNullSafe(blocks["_l"]) & rows["_block"].eqNullSafe(blocks["_b"]), "left")
    start = (F.col("_before") + F.col("_i")) * gap + F.greatest("_carried", F.col("_most") - F.col("_before") * gap)
    start = F.when(F.col("_at").isNotNull(), start)
    return joined.withColumns({"start": F.timestamp_micros(start), "waited": (start - F.col("_at")) / MICROS}).select(*requests.columns, "start", "waited")
