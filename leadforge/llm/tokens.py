"""Token counts by scanning flat token files for end-of-document identifiers.

Every task appends the ids of its documents to a file of unsigned 16-bit numbers, each document
closed by the separator; there is no index beside it. The scan cuts files into blocks of equal
size, finds separators in each block with one vectorised comparison, and gives for a block the tokens before the first separator, the
lengths between separators, and the tokens after the last. A prefix scan over a file's blocks
stitches what crosses a boundary: it carries the tokens since the last separator and the number of
separators so far, which is the ordinal of the next document. A block without a separator passes its
carry on.

Defined cases: null counts as empty; an empty text has 0 tokens; repeated rows are counted each;
tokens after a file's last separator are a document of their own; empty tables give empty results.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.llm.common import shared_dir, stored

RANKS = "byte_bpe_50k.tiktoken"
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20


@lru_cache(maxsize=1)
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, ranks: str | None):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode = tokenizer(ranks or public_tokenizers.path(RANKS)).encode_ordinary
        path, out, ordinal, size = f"{root}/{uuid.uuid4().hex}.tokens", None, 0, 0
        for pdf in batches:
            out = out or store.open_output_stream(path, compression=None)
            for text in pdf["text"]:
                ids = encode(text or "")
                ids.append(SEPARATOR)
                size += out.write(np.array(ids, "<u2").tobytes())
            n = len(pdf)
            yield pd.DataFrame({"path": path, "ordinal": np.arange(ordinal, ordinal + n), "id": pdf["id"], "bytes": pd.Series([None] * n, dtype="Int64")})
            ordinal += n
        if out:
            out.close()
            yield pd.DataFrame({"path": [path], "ordinal": [-1], "id": pd.Series([None], dtype="object"), "bytes": pd.Series([size], dtype="Int64")})

    return write


def write_tokens(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes token files; returns the files (path, bytes) and the order of documents in them (path, ordinal, id)."""
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("id"), df[text].alias("text"))
    wrote = stored(rows.mapInPandas(_writer(folder, ranks), f"path string, ordinal bigint, id {key_type}, bytes bigint"), "order")
    return wrote.where("ordinal < 0").select("path", "bytes"), wrote.where("ordinal >= 0").select("path", "ordinal", "id")


def scan_block(ids: np.ndarray, separator: int = SEPARATOR) -> tuple[int, list[int], int | None]:
    """Tokens before the first separator, lengths between separators, tokens after the last (None without separators)."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return len(ids), [], None
    return int(at[0]), (np.diff(at) - 1).tolist(), len(ids) - 1 - int(at[-1])


def _scanner(folder: str, block_tokens: int, separator: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = []
            for path, block in zip(pdf["path"], pdf["block"]):
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(2 * block_tokens, 2 * block_tokens * int(block)), "<u2")
                out.append((path, int(block), len(ids), *scan_block(ids, separator)))
            yield pd.DataFrame(out, columns=["path", "block", "n", "head", "inner", "tail"]).astype({"tail": "Int64"})

    return scan


def count_tokens(files: DataFrame, folder: str, block_tokens: int = BLOCK_TOKENS, separator: int = SEPARATOR) -> DataFrame:
    """(path, ordinal, n_tokens) of every document in the token files (path, bytes)."""
    blocks = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / (2 * block_tokens)).cast("int"))).alias("block"))
    parts = blocks.repartition("path", "block").mapInPandas(_scanner(folder, block_tokens, separator), "path string, block int, n bigint, head bigint, inner array<bigint>, tail bigint")
    parts = stored(parts, "parts")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("after_last", F.col("start") + F.col("n") - F.col("tail"))
    parts = parts.withColumns({
        "carry": F.col("start") - F.coalesce(F.max("after_last").over(before), F.lit(0)),
        "done": F.coalesce(F.sum(F.when(F.col("tail").isNotNull(), F.size("inner") + 1).otherwise(0)).over(before), F.lit(0)),
        "final": F.col("block") == F.max("block").over(W.partitionBy("path")),
    })
    first = F.array(F.col("carry") + F.col("head"))
    open_end = F.when(F.col("tail").isNull(), F.col("carry") + F.col("n")).otherwise(F.col("tail"))
    lengths = F.when(F.col("tail").isNotNull(), F.concat(first, "inner")).otherwise(F.array().cast("array<bigint>"))
    lengths = F.when(F.col("final") & (open_end > 0), F.concat(lengths, F.array(open_end))).otherwise(lengths)
    return parts.select("path", F.posexplode(lengths).alias("i", "n_tokens"), "done").select("path", (F.col("done") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Key and n_tokens of every row: written to token files in the shared folder, counted by the scan."""
    folder = f"{shared_dir(df.sparkSession)}/tokens"
    files, order = write_tokens(df, folder, key, text)
    # sorted runs of paths and ordinals shrink to nothing in files: the planner would take millions of rows for few and send them to the driver
    counted = count_tokens(files, folder, block_tokens).hint("merge")
    return order.join(counted, ["path", "ordinal"], "left").select(F.col("id").alias(key), "n_tokens")
