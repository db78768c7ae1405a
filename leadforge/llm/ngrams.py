"""N-gram Jaccard join by prefix trees, with connected components of the links.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with the same set
are one node. Grams have one global order: by falling rarity as a fixed table of counters sees it,
then by hash. The join has four steps.

1. Prefixes. Sets that reach the threshold share k grams among the first ``size - ceil(threshold *
   size) + k`` grams of the order, so only those are shown; k grows with the size. Rare grams come first: a passage that
   many documents quote is hardly ever in a prefix. A node that meets others in fewer grams than any
   partner would share has no partner and is peeled off, which removes what meets by chance.
2. Blocks. Of the nodes that show the same gram the one with the smallest number is its pivot, and
   a node belongs to the blocks of its grams' pivots. Two nodes that show a common gram are
   in a common block. A node leaves out the pivots of its fewest grams, less than half of what it shares with any
   partner: as partners leave out less than half too, they still meet, and no link is lost.
   Blocks over a fixed size are cut into chunks in the order of set sizes; a chunk is a task.
3. Prefix trees. In a task the sets, ordered by falling frequency and then by hash, are stored in a
   trie; each set walks it, sharing the partial overlap of common prefixes, and leaves a subtree
   when the lengths that remain cannot reach the threshold, or when all of it is in the set's component already.
   A few seeds of a block are put into each of its chunks, so a family's chunks join one component.
4. The rest. Pairs across chunks are only open where a block still has several components: those
   outside of its largest one are compared with every chunk that their sizes can reach.

No pairs of a group are ever listed: tasks hold sets and return a spanning forest of their links.
All decisions are exact up to equal 64-bit hashes of different n-grams. Where a large block falls
apart into many components, step 4 costs the product of its rest and its chunks within reach, in time and in copies.

Defined cases: null and empty texts have no set and link with nothing; texts with fewer words than
n have their whole word sequence as the only gram; equal sets, repeated rows included, are linked;
null keys never name a component; empty tables give empty results; columns of the input are not
touched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadforge.llm.common import slices, small, stored, without
from leadforge.llm.components import components

#: Sets and grams of a chunk, about; and how many members of a block go to each of its chunks besides the pivot.
CHUNK_SETS, CHUNK_GRAMS, SEEDS = 400, 1_000_000, 3
#: Bits that number a counter of the rarity table (2 MB for a task, whatever the input), and of one of its parts.
COUNTER_BITS, COUNTER_PART_BITS = 20, 14
#: Bits of the maps that every task gets (2 MB, whatever the input), and of one of their blocks.
MAP_BITS, MAP_BLOCK_BITS = 24, 18
#: Rows of the table of chosen nodes (about 64 bytes each) up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Grams, in percent of a set, that its prefix is longer than one shared gram needs.
MORE_PERCENT = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Fixed random values: one for each byte, and an odd base of the word polynomial.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
#: Bytes that are hashed at once.
WINDOW = 1 << 16


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    inverse = np.full(WINDOW, np.uint64(pow(_BASE, -1, 1 << 64)))
    power = np.full(WINDOW, np.uint64(_BASE))
    inverse[0] = power[0] = 1
    return np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word of at most WINDOW bytes: a polynomial of its bytes, from differences of running sums."""
    raw = np.frombuffer(data, np.uint8)
    power, inverse = _powers()
    starts, ends = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True)).reshape(-1, 2).T
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
    return starts, _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and 64-bit hash of every word of a byte string, window by window; a word that fills a window is hashed on its own."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data) or end - at == WINDOW:
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                word = re.compile(rb"[^ \t\n\x0b\x0c\r]+").match(data, at)
                starts.append(np.array([at]))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(word[0])], np.uint64))
                at = word.end()
                continue
            end = cut + 1
        s, h = _hashed(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    grams = np.full(max(0, len(words) - width + 1), np.uint64(width))
    for k in range(width):
        grams = _mix(grams + words[k : len(words) - width + 1 + k])
    return grams


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the ordered 64-bit hashes of the distinct word n-grams of its A-Z-lower-cased form."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = 0
    while first < len(encoded):
        last, size = first + 1, len(encoded[first])
        while last < len(encoded) and size + len(encoded[last]) < WINDOW:
            size += len(encoded[last]) + 1
            last += 1
        part = encoded[first:last]
        places, words = word_hashes(b"\n".join(part).lower())
        bounds = np.searchsorted(places, np.cumsum([0, *(len(x) + 1 for x in part)]))
        grams = _grams(words, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield _distinct(grams[a : b - n + 1]) if b - a >= n else _grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        first = last


def gram_set(text: str | None, n: int) -> np.ndarray:
    """The set of a single text."""
    return next(gram_sets([text], n))


def set_node(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _node_number(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def counter_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Places of counts on a fine logarithmic scale of 16 bits."""
    return np.minimum(65535, 2048 * np.log2(1.0 + counts)).astype(np.uint16)


def shared_grams(size: int) -> int:
    """Grams that the prefixes of two linked sets share, if the smaller has this size."""
    return 1 + MORE_PERCENT * size // 100


def least_shared(size: int, percent: int) -> int:
    """Grams that a set's prefix shares with that of any partner, at least."""
    return shared_grams(-(-percent * size // 100))


def prefix(grams: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """Names of the first grams of a set in the global order, as many as a partner's prefix must meet.

    Name and order are one value: the level of the gram's counter over 48 bits of its hash. Grams that
    share a value are one to the order, which can only make sets meet that need not.
    """
    if not len(grams):
        return grams
    names = (levels[counter_of(grams)].astype(np.uint64) << np.uint64(48)) | (grams & np.uint64((1 << 48) - 1))
    shown = len(grams) + shared_grams(len(grams)) + (-percent * len(grams)) // 100
    return np.partition(names, shown - 1)[:shown] if shown < len(names) else names


def trie(paths: list[np.ndarray], sizes: np.ndarray) -> tuple[list, list[int]]:
    """Compressed prefix tree and the order of its sets: nodes [segment, children, low, mid, high, smallest set, longest path].

    The sets of a node are at places low to high of the order; those before mid end at the node.
    """
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
    lengths = [len(paths[i]) for i in order]
    ordered = sizes[order]
    root: list = [None, [], 0, 0, len(order), 0, 0]
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        low, high = node[2], node[4]
        a, b = paths[order[low]], paths[order[high - 1]]
        end = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:end] != b[depth:end])
        common = depth + int(differ[0]) if len(differ) else end
        mid = low
        while mid < high and lengths[mid] == common:
            mid += 1
        node[0], node[3], node[5], node[6] = a[depth:common], mid, int(ordered[low:high].min()), max(lengths[low:high])
        start = mid
        for k in range(mid + 1, high + 1):
            if k == high or paths[order[k]][common] != paths[order[start]][common]:
                child: list = [None, [], start, start, k, 0, 0]
                node[1].append(child)
                stack.append((child, common))
                start = k
    return root, order


def trie_join(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join components: a spanning forest of the pairs that reach the threshold.

    ``side``: only pairs of different sides are compared. ``label``: sets with the same one are in one component already.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -count))] = np.arange(len(values))
    shared = int((count > 1).sum())
    paths = [np.sort(p[p < shared]) for p in np.split(rank[place], np.cumsum(sizes)[:-1])]
    root, order = trie(paths, sizes)
    of = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1][order]
    sides = None if side is None else side[order].tolist()
    ordered, links, held = sizes[order].tolist(), [], np.zeros(shared, bool)
    for at in range(1, len(order)):
        path, size, own = paths[order[at]], ordered[at], of[at]
        held[path] = True
        stack = [(root, 0, 0)]
        while stack:
            (segment, children, low, mid, high, smallest, longest), overlap, depth = stack.pop()
            if low >= at or (of[low : min(high, at)] == own).all():
                continue
            gone = 0
            if len(segment):
                overlap += int(np.count_nonzero(held[segment]))
                depth += len(segment)
                gone = int(np.searchsorted(path, segment[-1], "right"))
            if (100 + percent) * (overlap + min(len(path) - gone, longest - depth)) < percent * (size + smallest):
                continue
            for y in range(low, min(mid, at)):
                if of[y] != own and (sides is None or sides[y] != sides[at]) and overlap and (100 + percent) * overlap >= percent * (size + ordered[y]):
                    links.append((order[y], order[at]))
                    of[of == own] = of[y]
                    own = of[y]
            stack.extend((child, overlap, depth) for child in children)
        held[path] = False
    return links


def _describe(n: int):
    """A row for each document, and at the end of a task the counters of its grams, part by part."""
    names = ["id", "row_key", "n", "node", "nid", "part", "counts"]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, ids = np.zeros(1 << COUNTER_BITS, np.uint32), None
        for pdf in batches:
            ids = pdf["id"]
            nodes, sizes, held, waiting = [], [], [], 0
            for s in gram_sets(pdf["text"].tolist(), n):
                nodes.append(set_node(s) if len(s) else None)
                sizes.append(len(s))
                held.append(s)
                waiting += len(s)
                if waiting > 1_000_000:
                    counts += np.bincount(counter_of(np.concatenate(held)), minlength=len(counts)).astype(np.uint32)
                    held, waiting = [], 0
            if waiting:
                counts += np.bincount(counter_of(np.concatenate(held)), minlength=len(counts)).astype(np.uint32)
            numbers = pd.Series([None if x is None else _node_number(x) for x in nodes], dtype="Int64", index=pdf.index)
            yield pd.DataFrame({"id": ids, "row_key": pdf["row_key"], "n": sizes, "node": nodes, "nid": numbers, "part": pd.Series(pd.NA, dtype="Int64", index=pdf.index), "counts": None})[names]
        parts = counts.reshape(-1, 1 << COUNTER_PART_BITS)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            none = pd.Series(pd.NA, dtype="Int64", index=range(len(some)))
            yield pd.DataFrame({"id": ids.iloc[:0].reindex(range(len(some))), "row_key": none, "n": none, "node": None, "nid": none, "part": some, "counts": [zlib.compress(parts[i].tobytes(), 1) for i in some]})[names]

    return describe


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for part, counts in zip(pdf["part"].tolist(), pdf["counts"]):
            counts = np.frombuffer(zlib.decompress(counts), np.uint32)
            total[part] = total[part] + counts if part in total else counts.astype(np.uint64)
    yield pd.DataFrame({"part": list(total), "levels": [levels_of(x).tobytes() for x in total.values()]})


def rarity_levels(counted: DataFrame) -> np.ndarray:
    """Levels of all counters from rows (part, counts)."""
    out = np.zeros((1 << (COUNTER_BITS - COUNTER_PART_BITS), 1 << COUNTER_PART_BITS), np.uint16)
    # 64 rows of 32 KB, whatever the input: one job brings them, an iterator would be a job for each partition
    for row in counted.repartition("part").mapInPandas(_summed, "part int, levels binary").collect():
        out[row["part"]] = np.frombuffer(row["levels"], np.uint16)
    return out.reshape(-1)


SHOWN = "nid bigint, need int, gram bigint"


def _prefixes(n: int, percent: int, levels, met=None):
    """SHOWN rows; with a map, only grams that may be in it."""

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            numbers, needs, parts = [], [], []
            for s in gram_sets(pdf["text"].tolist(), n):
                if len(s):
                    shown = _mix(prefix(s, percent, levels.value)).view(np.int64)
                    shown = shown if met is None else shown[mapped(met.value, shown)]
                    if len(shown):
                        numbers.append(_node_number(set_node(s)))
                        needs.append(least_shared(len(s), percent))
                        parts.append(shown)
            if parts:
                lengths = [len(p) for p in parts]
                yield pd.DataFrame({"nid": np.repeat(np.array(numbers, np.int64), lengths), "need": np.repeat(np.array(needs, np.int32), lengths), "gram": np.concatenate(parts)})

    return show


def met_grams(shown: DataFrame) -> DataFrame:
    """(gram, pivot) of the grams that several nodes show; pivot is the smallest of them."""
    met = shown.groupBy("gram").agg(F.min("nid").alias("pivot"), F.max("nid").alias("top"))
    return met.where(F.col("pivot") != F.col("top")).select("gram", "pivot")


def peeled(shown: DataFrame, met: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows and met grams of the nodes that show as many met grams as a partner would share.

    Dropping a node can take others below their need, so this is done in rounds; each may be the last
    without losing a link, since it only ever drops nodes that cannot have a partner.
    """
    for _ in range(rounds):
        rows = stored(shown.join(small(met.select("gram"), BROADCAST_ROWS), "gram", "left_semi").distinct(), "rows")
        enough = rows.groupBy("nid").agg(F.count(F.lit(1)).alias("has"), F.max("need").alias("least")).where("has >= least").select("nid")
        shown = stored(rows.join(enough, "nid", "left_semi"), "peeled")
        met = stored(met_grams(shown), "met")
    return shown, met


def members_of(shown: DataFrame, met: DataFrame) -> DataFrame:
    """(nid, block): the pivots of each node's met grams, without those of its fewest grams."""
    by_pivot = shown.join(small(met, BROADCAST_ROWS), "gram").groupBy("nid", "pivot").agg(F.count(F.lit(1)).alias("grams"), F.max("need").alias("need"))
    fewest = F.sum("grams").over(W.partitionBy("nid").orderBy(F.col("nid") == F.col("pivot"), "grams", "pivot").rowsBetween(W.unboundedPreceding, 0))
    return by_pivot.withColumn("_so_far", fewest).where(2 * F.col("_so_far") > F.col("need") - 1).select("nid", F.col("pivot").alias("block"))


def _map_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << MAP_BLOCK_BITS, bool)
    bits[pdf["bit"]] = True
    return pd.DataFrame({"block": [int(key[0])], "bits": [np.packbits(bits).tobytes()]})


def key_map(df: DataFrame, key: str) -> np.ndarray:
    """A bit for the leading MAP_BITS bits of every value of a long column, packed; of a fixed size."""
    lead = F.shiftrightunsigned(key, 64 - MAP_BITS)
    bits = df.select(F.shiftright(lead, MAP_BLOCK_BITS).cast("int").alias("block"), lead.bitwiseAND((1 << MAP_BLOCK_BITS) - 1).cast("int").alias("bit")).distinct()
    out = np.zeros((1 << (MAP_BITS - MAP_BLOCK_BITS), 1 << (MAP_BLOCK_BITS - 3)), np.uint8)
    for row in bits.groupBy("block").applyInPandas(_map_block, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def mapped(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a map: all that are, and few others."""
    lead = keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (bits[lead >> np.uint64(3)] >> (7 - (lead & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _sets(n: int, wanted=None):
    """Sets of texts; ``wanted``: a map of row keys, of which others are left out."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if wanted is not None:
                pdf = pdf[mapped(wanted.value, pdf["row_key"].to_numpy())]
            for i in range(0, len(pdf), 500):
                some = pdf.iloc[i : i + 500]
                sets = list(gram_sets(some["text"].tolist(), n))
                yield pd.DataFrame({"row_key": some["row_key"], "made": [set_node(s) for s in sets], "grams": [s.tobytes() for s in sets]})

    return load


def stars(links: list[tuple[int, int]], node: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The same components as ``links`` between places of ``node``, every linked node beside the smallest of its component."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for i, j in links:
        i, j = sorted((root(i), root(j)), key=node.__getitem__)
        up[j] = i
    return [(node[i], node[r]) for i in up if (r := root(i)) != i]


def _join(percent: int):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in slices(batches, ["block", "low", "high"]):
            task = task.drop_duplicates("node")
            sets, node = [np.frombuffer(g, np.uint64) for g in task["grams"]], task["node"].tolist()
            side = task["side"].to_numpy()
            label = task["label"].to_numpy() if task["label"].iloc[0] is not None else None
            found = stars(trie_join(sets, percent, side if side.any() else None, label), node)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return join


def chunked(members: DataFrame, group: list[str]) -> DataFrame:
    """``members`` with ``chunk``: each group (of nodes with sizes n) cut in the order of sizes, sizes of many nodes by hash."""
    by_size = members.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("many"))
    weight = F.col("many") * F.greatest(F.lit(1.0 / CHUNK_SETS), F.col("n") / float(CHUNK_GRAMS))
    before = F.coalesce(F.sum(weight).over(W.partitionBy(*group).orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    cut = by_size.select(*group, "n", F.floor(before).cast("int").alias("base"), F.greatest(F.lit(1), F.ceil(weight)).cast("int").alias("spread"))
    return members.join(cut, [*group, "n"]).withColumn("chunk", F.col("base") + F.pmod(F.xxhash64("node"), F.col("spread")).cast("int")).drop("base", "spread")


TASK = ["block", "low", "high", "side", "label", "node"]


def _links(source: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that the tries of all tasks find; ``dealt``: row_key and the columns of TASK."""
    # only the chosen rows' texts are turned into sets again, and up to a counted number no others leave the scan; no text is shuffled
    texts, wanted = source.select("row_key", "text"), None
    if dealt.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(dealt.select("row_key").distinct()), "row_key", "left_semi")
        dealt = F.broadcast(dealt)
    else:
        wanted = source.sparkSession.sparkContext.broadcast(key_map(dealt, "row_key"))
    sets = texts.mapInPandas(_sets(n, wanted), "row_key bigint, made binary, grams binary")
    tasks = sets.join(dealt, "row_key").where(F.col("made") == F.col("node")).select(*TASK, "grams")
    tasks = tasks.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high")
    return stored(tasks.mapInPandas(_join(percent), "a binary, b binary"), "links")


def first_tasks(members: DataFrame) -> DataFrame:
    """Every chunk of every block, with the block's pivot and seeds in each."""
    chunks = members.select("block", "chunk").distinct()
    row = F.struct("node", "row_key", "chunk")
    pivots = members.where(F.col("nid") == F.col("block")).select("block", row.alias("row"))
    seeds = members.groupBy("block", F.pmod(F.xxhash64("node"), F.lit(SEEDS)).alias("k")).agg(F.min_by(row, F.xxhash64("node", F.lit(1))).alias("row")).select("block", "row")
    more = pivots.unionByName(seeds).join(chunks, "block").where(F.col("row.chunk") != F.col("chunk"))
    dealt = members.select("block", "chunk", "node", "row_key").unionByName(more.select("block", "chunk", "row.node", "row.row_key").distinct())
    return dealt.select("row_key", "block", F.col("chunk").alias("low"), F.col("chunk").alias("high"), F.lit(0).alias("side"), F.lit(None).cast("binary").alias("label"), "node")


def rest_tasks(members: DataFrame, roots: DataFrame, percent: int) -> DataFrame | None:
    """What the chunks leave open: in blocks of several chunks and components, the nodes outside of the
    largest component against every chunk that their sizes can reach. None if nothing is open."""
    several = members.groupBy("block").agg(F.max("chunk").alias("top")).where("top > 0").select("block")
    inside = members.drop("chunk").join(several, "block").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    inside = stored(inside, "inside")
    counts = inside.groupBy("block", "label").agg(F.count(F.lit(1)).alias("many"))
    largest = counts.groupBy("block").agg(F.max_by("label", F.struct("many", "label")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    if largest.isEmpty():
        return None
    rest = inside.join(largest, "block").withColumn("rest", F.col("label") != F.col("largest")).select("block", "rest", "label", "node", "n", "row_key")
    rest = stored(chunked(rest, ["block", "rest"]), "rest")
    spans = stored(rest.groupBy("block", "rest", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most")), "spans")
    one = spans.where("rest").select("block", F.col("chunk").alias("low"), F.col("least").alias("a"), F.col("most").alias("b"))
    other = spans.select("block", F.col("rest").alias("open"), F.col("chunk").alias("other"), F.col("least").alias("c"), F.col("most").alias("d"))
    pairs = one.join(other, "block").where((~F.col("open") | (F.col("low") <= F.col("other"))) & (100 * F.col("b") >= percent * F.col("c")) & (100 * F.col("d") >= percent * F.col("a")))
    pairs = pairs.withColumn("high", F.when(F.col("open"), F.col("other")).otherwise(-1 - F.col("other")))
    sides = F.array(F.struct(F.lit(True).alias("rest"), F.col("low").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("open").alias("rest"), F.col("other").alias("chunk"), F.lit(1).alias("side")))
    needs = pairs.select("block", "low", "high", F.explode(F.when(F.col("low") == F.col("high"), F.slice(sides, 1, 1)).otherwise(sides)).alias("x")).select("block", "low", "high", "x.*")
    return stored(rest.join(needs, ["block", "rest", "chunk"]).select("row_key", *TASK), "tasks")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, row_key (hash of id and text), n (grams), component (smallest id reachable by links).

    Two sets link when their Jaccard similarity is at least ``percent`` / 100, from 1 to 100 percent.
    """
    if not 1 <= percent <= 100 or n < 1:
        raise ValueError("percent is from 1 to 100 and n at least 1")
    source = df.select(df[key].alias("id"), df[text].alias("text"), F.xxhash64(df[key], df[text]).alias("row_key"))
    id_type = source.schema["id"].dataType.simpleString()
    described = stored(source.mapInPandas(_describe(n), f"id {id_type}, row_key bigint, n bigint, node binary, nid bigint, part int, counts binary"), "described")
    docs = described.where(F.col("part").isNull()).select("id", "row_key", "n", "node", "nid")
    nodes = docs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("nid").alias("nid"), F.min("row_key").alias("row_key"), F.max("n").alias("n"), F.min("id").alias("first"))
    nodes = stored(nodes, "nodes")
    # sets are made anew where they are needed: that costs less than to keep or move them
    broadcast, texts = df.sparkSession.sparkContext.broadcast, source.select("text")
    levels = broadcast(rarity_levels(described.where(F.col("part").isNotNull()).select("part", "counts")))
    met = stored(met_grams(texts.mapInPandas(_prefixes(n, percent, levels), SHOWN)), "met")
    # most grams belong to one set: they are dropped where they are made, before any second shuffle
    shown = texts.mapInPandas(_prefixes(n, percent, levels, broadcast(key_map(met, "gram"))), SHOWN)
    members = stored(members_of(*peeled(shown, met)), "routes")
    several = members.groupBy("block").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("block")
    members = members.join(several, "block", "left_semi")
    members = stored(chunked(members.join(nodes.drop("first"), "nid"), ["block"]), "members")
    links = _links(source, stored(first_tasks(members), "tasks"), n, percent)
    roots = stored(components(links), "roots")
    if (tasks := rest_tasks(members, roots, percent)) is not None:
        # what is joined already comes as the stars it became
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stored(components(joined.unionByName(_links(source, tasks, n, percent))), "roots")

    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stored(named.groupBy("root").agg(F.min("first").alias("component")), "least")
    named = stored(named.join(least, "root").select("node", "component"), "named")
    some, none = docs.where(F.col("node").isNotNull()), docs.where(F.col("node").isNull())
    return some.join(named, "node").select("id", "row_key", "n", "component").unionByName(none.select("id", "row_key", "n", F.col("id").alias("component")))


def drop_similar(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each group of linked ones: the one with the smallest key."""
    # an id may be that of several texts, so id and text say which row goes
    gone = similar_groups(df, key, text, n, percent).where(F.col("id") != F.col("component")).select("id", "row_key").distinct()
    return without(df, stored(gone, "gone"), {"id": df[key], "row_key": F.xxhash64(df[key], df[text])})
