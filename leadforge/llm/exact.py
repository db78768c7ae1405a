"""Exact deduplication through a minimal perfect hash over historical distinct digests.

A text's identity is the SHA-256 of its UTF-8 form after each white-space run became one space.
History is reduced to distinct digests with their winner and count. Digests are dealt into small
shards; each shard gets a minimal perfect hash: levels of bit arrays, where a key belongs to the
first level at which nobody shares its place, and its slot is the rank of its bit. Slots hold the
full digest and the winner's locator. A new digest is looked up in its shard and believed only
after all 32 bytes agree; digests that are not members are grouped among themselves.

Groups are pre-aggregated to one row per digest and map task before any shuffle, so a digest that
a third of all rows share is no hot key; the join back to rows may be split by adaptive execution.

Defined cases: null counts as empty and all empty texts are equal; a null key never wins unless
the whole group has null keys (then ``keep_id`` is null and no row is marked as kept); rows that repeat
key and text of the row that stays are the same document and marked as kept too. ``drop_copies`` keeps
one row of each text whatever its keys: where several rows could stay, the first by a hash of all their columns.
Keys may be of any ordered type; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leadforge.llm.common import SPACE, slices, stored, without

#: Digests of a shard, on average: a bounded amount of work for one Python call.
SHARD_DIGESTS = 4096
#: Places for each remaining key of a level.
ROOM = 1.5
MAX_LEVELS = 200

SHARDS = "shard int, sizes array<int>, bits binary, digests binary, winners array<{id}>, counts array<bigint>"


def text_digest(text: Column) -> Column:
    """32 bytes: SHA-256 of the white-space-normalised text; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key (two unsigned longs) at a level of so many places."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.tobytes(), dtype="<u8").reshape(-1, 4)[:, :2]


def build_function(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all bits, and the slot of each of the distinct digests (rows of 32 bytes)."""
    keys, left = _keys(digests), np.arange(len(digests))
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("digests of a shard are not distinct")
        size = max(1, int(ROOM * len(left)))
        at = _places(keys[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, flat, slots_of(digests, sizes, flat)


def slots_of(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot that the function gives each digest; -1 where no level claims it. Members and others alike: compare bytes."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    keys, slot, base = _keys(digests), np.full(len(digests), -1, np.int64), 0
    left = np.arange(len(digests))
    for level, size in enumerate(sizes):
        at = base + _places(keys[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slot


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _plain(keys: pd.Series) -> list:
    """Keys as Python values; whole numbers stay whole beside nulls."""
    numbers = keys.dtype.kind in "fiu"
    return [None if pd.isna(x) else int(x) if numbers else x for x in keys]


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for shard in slices(batches, ["shard"]):
        digests = _matrix(shard["digest"])
        sizes, bits, slot = build_function(digests)
        order = np.argsort(slot)
        yield pd.DataFrame({
            "shard": [int(shard["shard"].iloc[0])], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "digests": [digests[order].tobytes()],
            "winners": [_plain(shard["winner"].iloc[order])], "counts": [shard["n"].iloc[order].astype("int64").tolist()],
        })


def distinct_digests(digests: DataFrame) -> DataFrame:
    """One row per digest: its smallest id and its number of rows."""
    return digests.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n"))


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 49, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shards_for(*digests: int) -> int:
    """Shards that keep the largest of several sets of distinct digests near SHARD_DIGESTS each."""
    return max(1, *(-(-n // SHARD_DIGESTS) for n in digests))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Table of shards, each a minimal perfect hash with its slots, from distinct digests."""
    dealt = history.withColumn("shard", shard_of(F.col("digest"), shards)).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(_build, SHARDS.format(id=history.schema["winner"].dataType.simpleString()))


def _look_up(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Batch digests with what history knows of them (nulls for those that are not members)."""
    winner, n, member = np.full(len(batch), None, object), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
    if len(index) and len(batch):
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held, asked = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), _matrix(batch["digest"])
        slot = slots_of(asked, sizes, bits)
        member = slot >= 0
        member[member] = (held[slot[member]] == asked[member]).all(axis=1)
        for i in np.flatnonzero(member):
            winner[i] = row["winners"][slot[i]]
        n[member] = np.asarray(row["counts"], np.int64)[slot[member]]

    def typed(values) -> pd.Series:
        values = _plain(pd.Series(values))
        return pd.Series(values, dtype="Int64") if any(isinstance(x, int) for x in values) else pd.Series(values, dtype=object)

    return pd.DataFrame({"digest": batch["digest"].to_numpy(), "old_winner": typed(winner), "old_n": n, "member": member, "winner": typed(batch["winner"]), "n": batch["n"].astype("int64").to_numpy()})


def resolve(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Winner and count of every digest of ``history`` and ``batch`` (both: digest, id)."""
    old = stored(distinct_digests(history), "history")
    new = stored(distinct_digests(batch), "batch")
    # a shard holds its digests of both sides at once
    shards = shards_for(old.count(), new.count())
    index = stored(build_index(old, shards), "index")
    new = new.withColumn("shard", shard_of(F.col("digest"), shards))
    id_type = new.schema["winner"].dataType.simpleString()
    looked_up = f"digest binary, old_winner {id_type}, old_n bigint, member boolean, winner {id_type}, n bigint"
    found = stored(index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_look_up, looked_up), "lookups")
    seen = found.select("digest", F.least("old_winner", "winner").alias("keep_id"), (F.col("old_n") + F.col("n")).alias("group_size"))
    only_old = old.join(found.where("member").select("digest"), "digest", "left_anti").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
    return seen.unionByName(only_old)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, digest, keep_id, group_size, kept.

    The rows with whole-number keys up to the middle of the key range are the history, the others the new batch;
    other keys are halved by hash. The result is the same for any split.
    """
    digests = stored(df.select(df[key].alias("id"), text_digest(df[text]).alias("digest")), "digests")
    if isinstance(digests.schema["id"].dataType, IntegralType):
        low, high = digests.agg(F.min("id"), F.max("id")).first()
        past = F.coalesce(F.col("id") <= (low + (high - low) // 2 if low is not None else 0), F.lit(False))
    else:
        past = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    winners = stored(resolve(digests.where(past), digests.where(~past)), "winners")
    return digests.join(winners, "digest").withColumn("kept", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)))


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, with all its columns: one with the smallest key of its digest."""
    rows = exact_groups(df, key, text).groupBy("id", "digest").agg(F.count(F.lit(1)).alias("many"), F.first("keep_id").alias("keep_id"))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    rows = stored(rows.where(~stays | (F.col("many") > 1)).select("id", "digest", stays.alias("stays")), "rows")
    keys = {"id": df[key], "digest": text_digest(df[text])}
    out, several = without(df, rows.select("id", "digest"), keys), rows.where("stays")
    if several.isEmpty():
        return out
    # equal digests may differ in white space and other columns, so the row that stays is chosen by all of them
    row = F.struct(*(df[c] for c in df.columns))
    loose = df.select(row.alias("row"), keys["id"].alias("id"), keys["digest"].alias("digest"), F.sha2(F.to_json(row), 256).alias("rank"))
    same = [loose[c].eqNullSafe(several[c]) for c in ("id", "digest")]
    loose = loose.join(several, same, "left_semi")
    return out.unionByName(loose.groupBy("digest").agg(F.min_by("row", "rank").alias("row")).select("row.*"))
