"""Document fingerprints by consistent weighted sampling, in native expressions.

The terms of a text are its runs of five words (a shorter text is one term), weighted by how often each occurs. For each of ``registers``
independent draws a term gets two gamma(2, 1) numbers and a uniform one from hashes of the term and the draw; with them its weight is rounded
down to a step of the term's own grid, and the term with the smallest resulting key is the draw's sample. Two texts have the same
sample with a probability that equals the generalised Jaccard similarity (sum of least weights over sum of largest) of their weighted terms.
A fingerprint holds 16 bits of each sample in hex, so unequal samples look equal once in 65,536 times.

Each document is paired with the next one by ascending id. Texts move once, to blocks of the id order that are cut at quantiles of the ids; a
guard copy of each block's first document goes to the block before. An id that many rows have is cut further by text, so no block grows with
one id; rows that repeat both id and text share a block, which is sorted with spilling and never held.

Edge cases: a null text counts as empty. Ids are whole numbers; a null one comes first. Rows with one id are ordered by a hash of the text, then by the text.
The next document of the last is the first, of a single one itself. A text without words has no terms; two such texts have likeness 1, one
and another text some 0. Repeated rows are rows of their own. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadforge.llm.common import let, stored, words

#: Words in a term; samples in a fingerprint.
TERM_WORDS = 5
REGISTERS = 48
#: Blocks of the id order for each shuffle partition.
BLOCKS = 4
#: Stands for the sample of a text without terms.
NO_SAMPLE = -1
LEAST_ID = -(2**63)
#: Bits of a place in the table of gamma quantiles.
TABLE_BITS = 12
#: Binary places of logarithms of weights and of grids, and of keys.
GRID, KEY = 24, 31
#: Samples that one grouping finds: code for many more at once is too large to be compiled.
LANES = 48


def weighted_terms(text: Column, n: int = TERM_WORDS) -> Column:
    """array of struct(first, sorted hashes): see :func:`term_runs`; the hashes of a text's terms in order, one for each occurrence."""

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(let(words(text), hashes))


def term_runs(sorted_hashes: Column) -> Column:
    """Places at which a new term begins in sorted hashes."""
    places = F.sequence(F.lit(0), F.size(sorted_hashes) - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get(sorted_hashes, i) != F.get(sorted_hashes, F.greatest(i - 1, F.lit(0)))))
    return F.when(F.size(sorted_hashes) > 0, begins).otherwise(F.array().cast("array<int>"))


def gamma_table(bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Quantiles of the gamma(2, 1) distribution, 1 - (1 + x) e^-x, by halving, and their logarithms; in parts of 2^-GRID and 2^-KEY."""
    share = (np.arange(2**bits) + 0.5) / 2**bits
    low, high = np.zeros(len(share)), np.full(len(share), 64.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return [(int(x * 2**GRID), int(np.log(x) * 2**KEY)) for x in high]


def sample_key(term: Column, log_weight: Column, draw: Column, gamma: Column, log_gamma: Column) -> Column:
    """The order key of a term in a draw, as a whole number whose low 24 bits tell the sample: the term and the step that its weight falls on.

    One hash gives both gamma numbers (places in a table of quantiles), the uniform one and the sample's mark. All is done in whole numbers: with
    r and c the gamma numbers and u the uniform one, the step is floor(ln weight / r + u) and the key ln c - r (step - u + 1).
    """
    z = F.xxhash64(term, draw)
    places = 2**TABLE_BITS - 1
    r = F.get(gamma, z.bitwiseAND(places).cast("int"))
    log_c = F.get(log_gamma, F.shiftright(z, TABLE_BITS).bitwiseAND(places).cast("int"))
    u = F.shiftright(z, 2 * TABLE_BITS).bitwiseAND(2**24 - 1)
    step = F.when(log_weight == 0, F.lit(0).cast("bigint")).otherwise(F.shiftright(F.call_function("div", F.shiftleft(log_weight, 24), r) + u, 24))
    key = log_c + (128 << KEY) - F.shiftright(r * (F.shiftleft(step + 1, 24) - u), 24 + GRID - KEY)
    return F.shiftleft(key, 24).bitwiseOR(F.shiftrightunsigned(z, 40).bitwiseXOR(step * 0x9E3779B1).bitwiseAND(2**24 - 1))


def hex_of(samples: list[Column]) -> Column:
    """Four hex digits of each sample."""
    return F.concat(*(F.lower(F.lpad(F.hex(s.bitwiseAND(0xFFFF)), 4, "0")) for s in samples))


def likeness(a: Column, b: Column, registers: int) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, 4 * i + 1, 4) == F.substring(b, 4 * i + 1, 4), 1).otherwise(0) for i in range(registers)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / float(registers)


def block_of(key: Column, text_hash: Column, bounds: list[int]) -> Column:
    """Number of the block: bounds below the id, and for an id that several bounds equal, a part of them by hash."""
    known = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    below = F.size(F.filter(known, lambda b: b < key))
    equal = F.size(F.filter(known, lambda b: b == key))
    part = F.floor((F.shiftright(text_hash, 32) + float(2**31)) / float(2**32) * equal)
    return (below + part).cast("int")


def in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (id, key, text, hash) with block, and guard rows: the first document of each block again in the block before, the first of all in the last."""
    spark = docs.sparkSession
    blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = docs.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 10 * blocks)).head()[0]
    docs = docs.withColumn("block", block_of(F.col("key"), F.col("hash"), quantiles or []))
    # a row for each block, of at most 4 times the shuffle partitions
    heads = stored(docs.groupBy("block").agg(F.min(F.struct("key", "hash")).alias("head")), "heads")
    order = Window.orderBy("block")
    last = F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("block"), F.col("head"), F.coalesce(F.lag("block").over(order), last).alias("before"))
    both = docs.join(F.broadcast(heads), "block", "left")
    first = (F.col("key") == F.col("head.key")) & (F.col("hash") == F.col("head.hash"))
    places = F.when(first, F.array(F.struct(F.col("block"), F.lit(False).alias("guard")), F.struct(F.col("before").alias("block"), F.lit(True).alias("guard"))))
    places = places.otherwise(F.array(F.struct(F.col("block"), F.lit(False).alias("guard"))))
    return both.select("id", "key", "text", "hash", F.explode(places).alias("p")).select("id", "key", "text", "hash", "p.block", "p.guard")


def edited(text: Column, following: Column) -> Column:
    """A text whose last half is replaced by as much of the beginning of another."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS) -> DataFrame:
    """(id, n_chars, edited_digest, fingerprint, edited_fingerprint, near_edited, near_next) of every document; the digest is the SHA-256 of the edited text.

    After the texts have moved to their blocks, nothing more is shuffled: all further grouping is by rows of a block.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[id_col].cast("bigint"), F.lit(LEAST_ID)).alias("key"), text.alias("text"), F.xxhash64(text).alias("hash"))
    order = Window.partitionBy("block").orderBy("guard", "key", "hash", "text")
    rows = in_blocks(docs).select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("following"))
    rows = rows.withColumn("edited", F.when(~F.col("guard"), edited(F.col("text"), F.col("following"))))
    digest = F.sha2("edited", 256)
    # what a row keeps beside its samples, as whole numbers: rows are then grouped in compact buffers
    kept = {"guard": F.col("guard").cast("int"), "id": F.col("key"), "no_id": F.col("id").isNull().cast("int"), "n_chars": F.char_length("text")}
    kept |= {f"digest{i}": F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(4)}
    rows = rows.select("block", "at", *(c.alias(n) for n, c in kept.items()), F.posexplode(F.array("text", "edited")).alias("side", "text"))
    rows = rows.where("text is not null")  # a guard has no edited text
    tables = df.sparkSession.createDataFrame([tuple(map(list, zip(*gamma_table())))], "gamma array<bigint>, log_gamma array<bigint>")
    known = [tables.select(c).scalar().alias(c) for c in tables.columns]  # columns, so that all draws share one copy
    terms = rows.select("block", "at", *kept, "side", weighted_terms(F.col("text")).alias("hashes"), *known)
    terms = terms.select("*", term_runs(F.col("hashes")).alias("begins"))
    terms = terms.select("*", F.posexplode_outer("begins").alias("place", "begin"))
    weight = F.coalesce(F.get("begins", F.col("place") + 1), F.size("hashes")) - F.col("begin")
    terms = terms.select("block", "at", *kept, "side", F.get("hashes", F.col("begin")).alias("term"), F.floor(F.ln(weight.cast("double")) * 2**GRID).alias("log_weight"), *tables.columns)
    lanes = [F.min(sample_key(F.col("term"), F.col("log_weight"), F.col("lane") + i, *map(F.col, tables.columns))).alias(f"s{i}") for i in range(LANES)]
    first_lanes = range(0, registers, LANES)
    terms = terms.select("*", F.explode(F.array(*(F.lit(g) for g in first_lanes))).alias("lane"))
    sides = terms.groupBy("block", "at", "side", "lane").agg(*(F.max(c).alias(c) for c in kept), *lanes)
    sides = sides.select("block", "at", "side", "lane", *kept, hex_of([F.coalesce(f"s{i}", F.lit(NO_SAMPLE)) for i in range(LANES)]).alias("piece"))
    pieces = {name: [F.max(F.when((F.col("side") == side) & (F.col("lane") == g), F.col("piece"))) for g in first_lanes] for side, name in enumerate(("fingerprint", "edited_fingerprint"))}
    both = sides.groupBy("block", "at").agg(*(F.max(c).alias(c) for c in kept), *(F.concat(*p).alias(name) for name, p in pieces.items()))
    both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("at"))).where("guard = 0")
    near = {f"near_{k}": likeness(F.col("fingerprint"), F.col(f"{k}_fingerprint"), registers) for k in ("edited", "next")}
    out_id = F.when(F.col("no_id") == 0, F.col("id")).cast(df.schema[id_col].dataType)
    digest = F.concat(*(F.lower(F.lpad(F.hex(f"digest{i}"), 16, "0")) for i in range(4)))
    return both.select(out_id.alias("id"), F.col("n_chars").cast("long").alias("n_chars"), digest.alias("edited_digest"), "fingerprint", "edited_fingerprint", *(c.alias(n) for n, c in near.items()))
