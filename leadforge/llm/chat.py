"""Chat formatting of maximal conversations.

Logs often hold a conversation once per turn: each snapshot is a prefix of the next. Every turn
gets a rolling hash of the conversation up to it (sums of four 32-bit lanes of the hash of place,
role and text, so that prefixes of long conversations are summed in blocks); a conversation whose last hash is
an inner prefix hash of another is a snapshot, and an anti-join drops it. Of equal conversations
the one with the smallest id stays. What stays is rendered turn by turn and assembled into parts of
a bounded number of turns, so no conversation is ever collected whole.

Defined cases: turns are ordered by (turn, role, text), nulls first; a repeated row is one turn; null
role and text are empty; rows without a conversation id form one conversation without id, which is not the one of an empty id; a marker inside a
text is broken by a space; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.llm.common import stored

#: Turn numbers of a block, and turns of an assembled part.
BLOCK, PART = 512, 256
LANES = [f"p{i}" for i in range(4)]


def prefix_hashes(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, place, turn, role, text, p0..p3): lanes of the hash of the conversation up to each turn."""
    rows = df.select(df[key].alias("id"), df[turn].alias("turn"), df[role].alias("role"), df[text].alias("text")).distinct()
    rows = rows.withColumns({"owner": F.when(F.col("id").isNull(), "none").otherwise(F.concat(F.lit("id "), F.col("id").cast("string"))), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))})
    rows = stored(rows, "turns")
    before = W.partitionBy("owner").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("owner", "block").orderBy("turn", "role", "text")
    sizes = rows.groupBy("owner", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("owner", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.join(sizes, ["owner", "block"]).withColumn("place", F.col("offset") + F.row_number().over(own))
    sha = F.sha2(F.concat_ws("\u0001", F.col("place").cast("string"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    placed = placed.withColumns({p: F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long") for i, p in enumerate(LANES)}).drop("offset")
    placed = stored(placed, "placed")
    sums = placed.groupBy("owner", "block").agg(*(F.sum(p).alias(p) for p in LANES))
    sums = sums.select("owner", "block", *(F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"before_{p}") for p in LANES))
    running = W.partitionBy("owner", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(sums, ["owner", "block"])
    return out.select("owner", "id", "place", "turn", "role", "text", *((F.sum(p).over(running) + F.col(f"before_{p}")).alias(p) for p in LANES))


def maximal(hashes: DataFrame) -> DataFrame:
    """Owners of conversations that are not a prefix of another, one of each group of equal ones."""
    lengths = hashes.groupBy("owner").agg(F.max("place").alias("n"))
    known = hashes.select("owner", "id", "place", *LANES).join(lengths, "owner")
    ends = known.where(F.col("place") == F.col("n")).groupBy("place", *LANES).agg(F.min(F.struct("id", "owner")).alias("k"))
    inner = known.where(F.col("place") < F.col("n")).select("place", *LANES).distinct()
    return ends.join(inner, ["place", *LANES], "left_anti").select(F.col("k.owner").alias("owner"))


def rendered(role: Column, text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_", "<| im_")
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), clean, F.lit("<|im_end|>\n"))


def render_turns(df: DataFrame, **names: str) -> DataFrame:
    """(id, owner, place, rendered) for the turns of maximal conversations."""
    hashes = stored(prefix_hashes(df, **names), "hashes")
    stay = stored(maximal(hashes), "stay")
    return hashes.join(stay, "owner", "left_semi").select("id", "owner", "place", rendered(F.col("role"), F.col("text")).alias("rendered"))


def formatted(df: DataFrame, part_turns: int = PART, **names: str) -> DataFrame:
    """(id, part, n_turns, text): maximal conversations as texts of at most ``part_turns`` turns each."""
    turns = render_turns(df, **names).withColumn("part", F.floor((F.col("place") - 1) / part_turns))
    lines = F.sort_array(F.collect_list(F.struct("place", "rendered")))
    parts = turns.groupBy("owner", "part").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["rendered"]), "").alias("text"))
    return parts.select("id", "part", "n_turns", "text")
