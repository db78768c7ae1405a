"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map, recording for
every normalised byte the source byte it comes from (the map may be empty: then only white space
changes). Pieces never reach across a word boundary of the normalised text, so each distinct word
is encoded once per task and looked up afterwards; pieces are projected to spans of the original
UTF-8 bytes through the recorded alignment.

Defined cases: null counts as empty; an empty text has only the begin and end ids; repeated rows
and very long texts are encoded like any other; empty tables give empty results. A byte piece covers its
own byte; the dummy prefix covers nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from leadforge.llm.common import small_batches

MODEL = "piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Words that a task remembers at once; then it starts anew.
REMEMBERED = 200_000
#: Rows and characters that are encoded at once, so that a batch of long texts is never held with all its ids and spans.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20
OUTPUTS = {"ids": "array<int>", "decoded": "string", "starts": "array<bigint>", "ends": "array<bigint>"}


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that ``source`` continues with."""
        if not self.units:
            return None
        unit = self.units[0]
        place, found = self._next(0, unit), None
        for i in range(at, len(source)):
            place ^= source[i]
            if place >= len(self.units):
                break
            unit = self.units[place]
            if unit & 0x800000FF != source[i]:
                break
            place = self._next(place, unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[place] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    @staticmethod
    def _next(place: int, unit: int) -> int:
        return place ^ (unit >> 10) << ((unit & 0x200) >> 6)


class Pieces:
    """A model with its normaliser, word memory and byte lengths of pieces."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec = proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        self.lengths = np.array([1 if p.type == p.BYTE else 0 if p.type == p.CONTROL else len(p.piece.encode()) for p in proto.pieces], np.int64)
        plain = not self.map.units and self.spec.add_dummy_prefix and self.spec.escape_whitespaces and not self.spec.remove_extra_whitespaces
        self.by_word = plain and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in proto.pieces)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        self.mark = np.array([self.library.piece_to_id(SPACE_MARK)], "<u4").tobytes()
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte where it comes from."""
        source, mark = text.encode(), SPACE_MARK.encode() if self.spec.escape_whitespaces else b" "
        if not source:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.spec.remove_extra_whitespaces:
            raw = np.frombuffer(source, np.uint8)
            wide = np.where(raw == 32, len(mark), 1)
            dummy = len(mark) * self.spec.add_dummy_prefix
            align = np.concatenate([np.zeros(dummy, np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]])
            return mark * self.spec.add_dummy_prefix + source.replace(b" ", mark), align
        out, align, at, trim = bytearray(), [], 0, self.spec.remove_extra_whitespaces
        if self.spec.add_dummy_prefix:
            out += mark
            align += [0] * len(mark)
        while at < len(source):
            hit = self.map.longest(source, at)
            step = hit[0] if hit else max(1, (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0) + 1)
            for byte in hit[1] if hit else source[at : at + step]:
                if byte != 32:
                    out.append(byte)
                    align.append(at)
                elif not trim or out and not out.endswith(mark):
                    out += mark
                    align += [at] * len(mark)
            at += step
        while trim and out.endswith(mark):
            del out[-len(mark) :], align[-len(mark) :]
        return bytes(out), np.array([*align, len(source)], np.int64)

    def _learn(self, words: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids, self.odd = {}, {}
        new = [w for w in words if w not in self.ids]
        for w, ids in zip(new, self.library.encode(new, num_threads=1)):
            self.ids[w] = np.array(ids, "<u4").tobytes() if w else self.mark
            if w and (back := self.library.decode(ids)) != w:
                self.odd[w] = back

    def _words(self, text: str) -> list[str]:
        """Words of the normalised text without their first mark; more marks before a word stay with it, as spaces."""
        spaced = text.replace(SPACE_MARK, " ")
        if "  " not in spaced and spaced[:1] != " ":
            return spaced.split(" ")
        return [w[1:] for w in re.findall(r" +[^ ]*", " " + spaced)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of each text with begin and end (little-endian unsigned 32-bit), and their decoded text."""
        if not self.by_word:
            ids = self.library.encode(texts, num_threads=1)
            return [self.begin + np.array(x, "<u4").tobytes() + self.end for x in ids], self.library.decode(ids, num_threads=1)
        out, back = [], []
        for text in texts:
            words = self._words(text) if text else []
            try:
                joined = b"".join([self.ids[w] for w in words])
            except KeyError:
                self._learn(set(words))
                joined = b"".join([self.ids[w] for w in words])
            out.append(self.begin + joined + self.end)
            back.append(" ".join([self.odd.get(w, w) for w in words] if self.odd else words))
        return out, back

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every id in the text's UTF-8 bytes."""
        _, align = self.normalise(text)
        ends = np.minimum(np.cumsum(self.lengths[np.frombuffer(ids, "<u4")]), len(align) - 1)
        at = align[ends]
        return np.concatenate([[0], at[:-1]]), at


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


ENCODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint"


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each batch a few at a time; a text over SLICE_CHARS comes alone or last."""
    for pdf in batches:
        begin, size = 0, 0
        for i, text in enumerate(pdf["text"]):
            size += len(text or "")
            if i + 1 - begin == SLICE_ROWS or size >= SLICE_CHARS:
                yield pdf.iloc[begin : i + 1]
                begin, size = i + 1, 0
        if begin < len(pdf):
            yield pdf.iloc[begin:]


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", outputs: Collection[str] = tuple(OUTPUTS), model: str | None = None, carry: str | None = None) -> DataFrame:
    """Key, n_tokens, ids_sha256, decoded_sha256, covered_bytes (source bytes that the spans cover); of ids, decoded text,
    starts and ends (byte spans) those that ``outputs`` names; then the column ``carry`` as it is."""
    small_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()
    path, wanted = model, [c for c in OUTPUTS if c in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(path or public_tokenizers.path(MODEL))
        for pdf in _slices(batches):
            texts = [t or "" for t in pdf["text"]]
            ids, back = pieces.encode(texts)
            spans = [pieces.spans(t, i) for t, i in zip(texts, ids)]
            out = pd.DataFrame({
                key: pdf["key"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back], "covered_bytes": [int((b - a).sum()) for a, b in spans],
            })
            made = {"ids": lambda: [np.frombuffer(i, "<u4").astype(np.int32) for i in ids], "decoded": lambda: back, "starts": lambda: [a for a, _ in spans], "ends": lambda: [b for _, b in spans]}
            for c in wanted:
                out[c] = made[c]()
            if carry:
                out[carry] = pdf["carry"]
            yield out

    more = "".join(f", {c} {OUTPUTS[c]}" for c in wanted)
    if carry:
        more += f", `{carry}` {df.schema[carry].dataType.simpleString()}"
    carried = [df[carry].alias("carry")] if carry else []
    return df.select(df[key].alias("key"), df[text].alias("text"), *carried).mapInPandas(run, f"`{key}` {key_type}, {ENCODED}{more}")
