"""Phrase collocation mining: exact counts of frequent phrases by multikey quicksort of suffix pointers, scored by their weakest cut.

Texts lose upper-case A-Z and are split into pieces and words in tasks; a word is the 64-bit hash of its bytes from there on (two frequent
words of a language with one hash are an error that names the remedy, another ``multiplier``). Words and pairs are counted by hash with sums
before the shuffle. Longer runs are not passed on to be counted: each task adds the sightings of runs whose pairs are all frequent to a table of hashed byte
counters, and the sums of these tables say which runs can't be frequent. A suffix ends before it becomes such a run, and one whose first three words are one is
abandoned. What is left of a suffix, at most ``longest`` words, is routed by its language and three leading words, equal suffixes of a task as one row with a count. Each task sorts pointers to its suffixes by
multikey three-way quicksort: the part equal to a pivot at some depth is one phrase and its weight is the phrase's count; parts lighter than
``least`` are abandoned unsorted. Tasks drop what is rare with the help of bit maps of bounded size (words 2 MB, pairs 4 MB, longer runs 16 MB at most, from 128 MB of counters
in a task at most); a full map spares less, and results stay exact.

Edge cases: a null text counts as empty, a null language as ``und``. Bytes that are not UTF-8 do not occur in Spark strings. Repeated rows count
each. Fewer than ``least`` sightings give no candidate; an empty table gives no rows. Ties of score and count are ordered by the phrase's
bytes. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadforge.llm.common import stored

#: Kinds of bytes: 0 in a word (upper-case letters are lowered), 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
BREAK = re.compile(r"[.,;:!?\n-\r]")
#: Characters that are split at once: some 100 MB of whole numbers.
CHUNK = 1 << 20
#: Bits of the maps of frequent words and of frequent pairs, and the least and most of that of longer runs.
WORD_BITS, PAIR_BITS, RUN_BITS = 24, 25, (16, 27)
#: A counter of a task that is full may stand for any number of sightings.
FULL = 255
#: Different rows that a task gathers before it passes them on: some 50 MB.
GATHERED = 1_000_000
#: Suffix rows of one sorting task, about.
SORTED = 400_000
MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 .. modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def tokens(texts: list[str], multiplier: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hashes with 0 between pieces, first byte and length of each, the bytes) of some texts, a break before and after each.

    The hash of a word is a polynomial of its bytes modulo 2^64, mixed; it is computed for all words at once from one running sum.
    """
    raw = b"\n" + b"\n".join(t.encode() for t in texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = (edge == 1).nonzero()[0], (edge == -1).nonzero()[0]
    with np.errstate(over="ignore"):
        power, inverse = (powers(x, 1 << len(data).bit_length()) for x in (multiplier | 1, pow(multiplier | 1, -1, 2**64)))
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data] + np.uint64(1)) * power[: len(data)], out=running[1:])
        h = mixed((running[end] - running[start]) * inverse[start] + (end - start).astype(np.uint64))
    h[h == 0] = 1
    breaks = (kind == 2).nonzero()[0]
    at = np.concatenate((start, breaks))
    order = np.argsort(at, kind="stable")
    hashes = np.concatenate((h, np.zeros(len(breaks), np.uint64)))[order].view(np.int64)
    return hashes, at[order], np.concatenate((end - start, np.zeros(len(breaks), np.int64)))[order], raw


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def slots(columns: list[np.ndarray], lang: str, bits: int) -> np.ndarray:
    """Map places of words or pairs of a language."""
    out = np.full(len(columns[0]), hash_of(lang), np.uint64)
    for c in columns:
        out = mixed(out ^ c.view(np.uint64))
    return (out >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(1000)
def hash_of(lang: str) -> np.uint64:
    return np.uint64(tokens([lang + "_"])[0].view(np.uint64).sum())


def bit_map(rows: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """Bit map of a stored table of words or pairs. Only words of the map reach the driver, at most 2^(bits - 6)."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                yield pd.DataFrame({"slot": np.unique(slots([part[c].to_numpy() for c in columns], lang, bits))})

    slot = rows.select("lang", *columns).mapInPandas(places, "slot bigint")
    cells = slot.groupBy(F.shiftright("slot", 5).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(2 ** (bits - 5), np.uint32)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.uint32)
    return out


def run_map(docs: DataFrame, pairs: np.ndarray, least: int, longest: int, bits: int) -> np.ndarray:
    """Bit map of the runs of three to ``longest`` words that may be seen ``least`` times: runs whose pairs are all marked are counted in 2^``bits`` hashed counters.

    Tasks pass on their counters in compressed pieces, at most 64 KB each and 256 at least, so rows depend on tasks and not on runs. Counters that runs share
    only count more, so no frequent run is missed.
    """
    pieces = max(256, 1 << bits >> 16)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << bits, np.uint8)
        for pdf in batches:
            for lang, texts in by_language(pdf):
                h = np.concatenate((tokens(texts)[0], np.zeros(longest, np.int64)))
                some = two = known_runs(h, 2, pairs, lang)
                for n in range(3, longest + 1):
                    some = some[:-1] & two[n - 2 :]
                    at = some.nonzero()[0]
                    slot, seen = np.unique(slots([h[at + i] for i in range(n)], lang, bits), return_counts=True)
                    cells[slot] = np.minimum(cells[slot] + seen, FULL)
        cells = cells.reshape(pieces, -1)
        for a in range(0, pieces, 32):
            if used := [i for i in range(a, a + 32) if cells[i].any()]:
                yield pd.DataFrame({"piece": used, "cells": [zlib.compress(cells[i].tobytes(), 1) for i in used]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for piece, cells in zip(pdf["piece"], pdf["cells"]):
                n = np.frombuffer(zlib.decompress(cells), np.uint8).astype(np.int64)
                total[piece] = total.get(piece, 0) + np.where(n == FULL, max(least, FULL), n)
        if total:
            yield pd.DataFrame({"piece": list(total), "bits": [np.packbits(t >= least, bitorder="little").tobytes() for t in total.values()]})

    found = docs.mapInPandas(count, "piece int, cells binary").repartition("piece").mapInPandas(add, "piece int, bits binary").toPandas()
    out = np.zeros((pieces, 2 ** (bits - 3) // pieces), np.uint8)
    for piece, part in zip(found["piece"], found["bits"]):
        out[piece] = np.frombuffer(part, np.uint8)
    return out.reshape(-1).view("<u4")


def bits_of(known: np.ndarray) -> int:
    """The bits of a bit map's places."""
    return len(known).bit_length() + 4


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def grouped(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, with the sum of their weights."""
    if not len(weights):
        return columns, weights
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
    at = new.nonzero()[0]
    return [c[at] for c in columns], np.add.reduceat(weights[order], at)


def by_language(pdf: pd.DataFrame) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, some CHUNK characters at a time; a longer text is cut between pieces."""
    for lang, part in pdf.groupby("lang"):
        held, size = [], 0
        for text in part["text"]:
            while len(text) > CHUNK and (cut := BREAK.search(text, CHUNK)):
                yield lang, [text[: cut.start()]]
                text = text[cut.end() :]
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield lang, held
                held, size = [], 0
        if held:
            yield lang, held


class Gatherer:
    """Rows of whole numbers by language, with equal rows as one. They are given out when GATHERED are left after equal ones have been joined."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.held, self.n, self.at_most = names, {}, 0, GATHERED

    def add(self, lang: str, columns: list[np.ndarray]) -> None:
        rows = grouped(columns, np.ones(len(columns[0]), np.int64))
        self.held.setdefault(lang, []).append(rows)
        self.n += len(rows[1])

    def join(self) -> None:
        for lang, parts in self.held.items():
            if len(parts) > 1:
                self.held[lang] = [grouped([np.concatenate([p[0][i] for p in parts]) for i in range(len(self.names))], np.concatenate([p[1] for p in parts]))]
        self.n = sum(len(p[1]) for parts in self.held.values() for p in parts)
        self.at_most = max(GATHERED, self.n + GATHERED // 2)

    def full(self) -> Iterator[pd.DataFrame]:
        """What must go now so that memory stays bounded."""
        if self.n >= self.at_most:
            self.join()
            if self.n >= GATHERED:
                yield from self.out()

    def out(self) -> Iterator[pd.DataFrame]:
        self.join()
        for lang, [(columns, n)] in self.held.items():
            for a in range(0, len(n), 50_000):
                yield pd.DataFrame({"lang": lang} | {c: x[a : a + 50_000] for c, x in zip(self.names, columns)} | {"f": n[a : a + 50_000]})
        self.held, self.n, self.at_most = {}, 0, GATHERED


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, h1, word, f) of all words; the row with h1 = 0 counts all words of its language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in by_language(pdf):
                h, at, size, raw = tokens(texts)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                total = int(n[u != 0].sum())
                u, first, n = u[u != 0], first[u != 0], n[u != 0]
                words = [raw[a : a + s].lower().decode() for a, s in zip(at[first], size[first])]  # bytes.lower() changes A-Z alone
                yield pd.DataFrame({"lang": lang, "h1": np.append(u, 0), "word": [*words, ""], "f": np.append(n, total)})

    return docs.mapInPandas(run, "lang string, h1 bigint, word string, f bigint").groupBy("lang", "h1").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("f").alias("f"))


def known_runs(h: np.ndarray, n: int, known: np.ndarray, lang: str) -> np.ndarray:
    """Whether the ``n`` words from each place on are within a piece and marked."""
    columns = [h[i : len(h) - n + 1 + i] for i in range(n)]
    out = np.logical_and.reduce([c != 0 for c in columns])
    at = out.nonzero()[0]
    out[at] = marked(known, slots([c[at] for c in columns], lang, bits_of(known)))
    return out


def pair_counts(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(lang, h1, h2, f) of pairs of words that the map marks."""
    names = ["h1", "h2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Gatherer(names)
        for pdf in batches:
            for lang, texts in by_language(pdf):
                h = np.append(tokens(texts)[0], 0)
                some = known_runs(h, 1, known, lang)
                at = (some[:-1] & some[1:]).nonzero()[0]
                held.add(lang, [h[at], h[at + 1]])
            yield from held.full()
        yield from held.out()

    return docs.mapInPandas(run, "lang string, h1 bigint, h2 bigint, f bigint").groupBy("lang", *names).agg(F.sum("f").alias("f"))


def suffixes(docs: DataFrame, pairs: np.ndarray, runs: np.ndarray, longest: int) -> DataFrame:
    """(lang, h1 .., f): suffixes of pieces whose first three words and their pairs are marked, cut at ``longest`` words and before the first pair or run from their start that is not; 0 after the end."""
    names = [f"h{i}" for i in range(1, longest + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Gatherer(names)
        for pdf in batches:
            for lang, texts in by_language(pdf):
                h = np.concatenate((tokens(texts)[0], np.zeros(2 * longest, np.int64)))
                two = known_runs(h, 2, pairs, lang)
                at = (two[:-1] & two[1:]).nonzero()[0]
                at = at[marked(runs, slots([h[at + k] for k in range(3)], lang, bits_of(runs)))]
                columns, on = [h[at + k] for k in range(3)], np.arange(len(at))
                for k in range(3, longest):
                    on = on[two[at[on] + k - 1]]
                    on = on[marked(runs, slots([*(c[on] for c in columns), h[at[on] + k]], lang, bits_of(runs)))]
                    columns.append(np.zeros(len(at), np.int64))
                    columns[k][on] = h[at[on] + k]
                held.add(lang, columns)
            yield from held.full()
        yield from held.out()

    return docs.mapInPandas(run, f"lang string, {', '.join(f'{c} bigint' for c in names)}, f bigint")


def multikey_quicksort(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a pointer, depth, weight) of every part of equal suffixes with ``least`` or more, for each depth.

    Pointers are parted three ways by their word at the depth; the equal part goes on at the next depth. 0 has ended and is not counted.
    """
    todo = [(np.arange(len(weights)), 0)]
    while todo:
        pointers, depth = todo.pop()
        word = columns[depth][pointers]
        middle = word[len(word) // 2]
        less, more = pointers[word < middle], pointers[word > middle]
        for part in (less, more):
            if len(part) and weights[part].sum() >= least:
                todo.append((part, depth))
        if middle != 0:
            equal = pointers[word == middle]
            if (weight := int(weights[equal].sum())) >= least:
                yield int(equal[0]), depth + 1, weight
                if depth + 1 < len(columns):
                    todo.append((equal, depth + 1))


def long_phrases(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, hs, f) of phrases of three and more words from suffixes of which those with equal three first words are in one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                parts.setdefault(lang, []).append(part.drop(columns="lang").to_numpy())
        for lang, tables in parts.items():
            rows = np.concatenate(tables)
            columns, weights = [np.ascontiguousarray(rows[:, i]) for i in range(longest)], rows[:, longest]
            found = [(p, d, w) for p, d, w in multikey_quicksort(columns, weights, least) if d >= 3]
            if found:
                yield pd.DataFrame({"lang": lang, "hs": [rows[p, :d].tolist() for p, d, _ in found], "f": [w for *_, w in found]})

    return routed.mapInPandas(run, "lang string, hs array<bigint>, f bigint")


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Stored tables (lang, h1, word, f), in which h1 = 0 counts all words, and (lang, hs, f) of all phrases seen ``least`` times or more."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(df[text_col], F.lit("")).alias("text"), F.coalesce(df[lang_col], F.lit("und")).alias("lang"))
    clash = F.when((F.col("word") != F.col("other")) & (F.col("h1") != 0), F.raise_error(F.lit("two words have one hash: take another multiplier"))).otherwise(F.col("word"))
    words = stored(word_counts(docs).where((F.col("f") >= least) | (F.col("h1") == 0)).select("lang", "h1", clash.alias("word"), "f"), "words")
    pairs = stored(pair_counts(docs, bit_map(words.where("h1 <> 0"), ["h1"], WORD_BITS)).where(F.col("f") >= least), "pairs")
    # a sixteenth of what makes a run frequent comes to a counter by chance, until the table has its full size
    bits = (16 * (pairs.agg(F.sum("f")).first()[0] or 0) // max(least, 1)).bit_length()
    two = bit_map(pairs, ["h1", "h2"], PAIR_BITS)
    runs = run_map(docs, two, least, longest, min(max(bits, RUN_BITS[0]), RUN_BITS[1]))
    tails = stored(suffixes(docs, two, runs, longest), "suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tails.count() // SORTED))
    longer = long_phrases(tails.repartition(parts, "lang", "h1", "h2", "h3"), least, longest)
    found = words.where("h1 <> 0").select("lang", F.array("h1").alias("hs"), "f").unionByName(pairs.select("lang", F.array("h1", "h2").alias("hs"), "f")).unionByName(longer)
    return words, stored(found, "phrases")


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in decimals of 38 digits: exact while counts are below 10^17 each."""
    wide = [c.cast("decimal(18,0)") for c in (a, n, left, right)]
    top = (F.lit(1000).cast("decimal(4,0)") * wide[0]).cast("decimal(20,0)") * wide[1]
    return F.call_function("div", top, wide[2] * wide[3])


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by their weakest cut.

    A phrase goes if one with a word more, before or behind, is as frequent; that covers all longer phrases, whose counts only fall.
    """
    words, phrases = frequent_phrases(df, text_col, lang_col, least, longest)
    size = F.size("hs")
    longer = phrases.where(size >= 3).select("lang", F.explode(F.array(F.slice("hs", 1, size - 1), F.slice("hs", 2, size - 1))).alias("hs"), F.col("f").alias("over"))
    covered = longer.groupBy("lang", "hs").agg(F.max("over").alias("over"))
    own = phrases.where(size >= 2).join(covered, ["lang", "hs"], "left").where(F.col("over").isNull() | (F.col("over") < F.col("f"))).select("lang", "hs", F.col("f").alias("a"))
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("*", F.slice("hs", F.lit(1), F.col("k")).alias("ls"), F.slice("hs", F.col("k") + 1, size - F.col("k")).alias("rs"))
    cuts = cuts.join(phrases.select("lang", F.col("hs").alias("ls"), F.col("f").alias("l")), ["lang", "ls"]).join(phrases.select("lang", F.col("hs").alias("rs"), F.col("f").alias("r")), ["lang", "rs"])
    cuts = cuts.join(words.where("h1 = 0").select("lang", F.col("f").alias("n")), "lang")
    scored = cuts.withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).groupBy("lang", "hs").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "hs", "cut.*")
    # rows beyond the first by score and count can't come back by their words: words are fetched for the others alone
    best = scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= first).drop("_rank")
    spelled = best.select("lang", "hs", F.posexplode("hs").alias("at", "h1")).join(words.select("lang", "h1", "word"), ["lang", "h1"])
    spelled = spelled.groupBy("lang", "hs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(spelled, ["lang", "hs"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return out.where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
