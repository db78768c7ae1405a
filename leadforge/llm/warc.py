"""WARC archives written and read as chunks, so that no task holds a whole record beyond its input row.

Writing: every task appends one gzip member per record to its own archive, block by block, and
reports byte ranges of whole members; the reports are the manifest. A task that is run again writes
another file, and only the files that the manifest names are read. Archives go to the shared folder through
pyarrow's file systems. Reading: byte ranges are streamed and inflated block by block into the
chunked record table, one row per record and chunk number, which carries the digest of the payload
so far; the last chunk of a record has the full digest.

Of records with equal payloads (from ``least_bytes`` on) the one with the largest id is the response and the others are
revisits that refer to it.

Defined cases: a null payload is empty; an empty payload has one chunk of 0 bytes; a null id is never
referred to unless all ids of its payload are null, and then those records are responses; rows that repeat id and payload of the
response are that record again and are responses too; line breaks in a url are percent-encoded and
a null url is empty; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadforge.llm.common import BROADCAST_KEYS, shared_dir, stored

BLOCK = 1 << 20
#: Compressed bytes after which a new range begins in the manifest.
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
NAME = "urn:leadforge:record:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, begin bigint, end bigint, records bigint"
CHUNKS = (
    "record_id bigint, url string, record_type string, refers_to bigint, declared_bytes bigint, declared_digest string, "
    "chunk_no bigint, chunk_bytes bigint, total_bytes bigint, digest_so_far string, last boolean, data binary"
)


def _encoded(text: str) -> Iterator[bytes]:
    for i in range(0, len(text), BLOCK):
        yield text[i : i + BLOCK].encode()


def _record(row: dict, date: str) -> Iterator[bytes]:
    """Bytes of a record, piece by piece."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{NAME}{row['id']}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{row['digest']}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{NAME}{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    if not revisit:
        yield from _encoded(row["payload"])
    yield b"\r\n\r\n"


def _writer(folder: str, date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, out, ranges, at, begin, records = f"{root}/{uuid.uuid4().hex}.warc.gz", None, [], 0, 0, 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                row = row._asdict()
                row |= {"id": "" if pd.isna(row["id"]) else int(row["id"]), "refers_to": "" if pd.isna(row["refers_to"]) else int(row["refers_to"]), "digest": base64.b32encode(bytes.fromhex(row["digest"])).decode()}
                out = out or store.open_output_stream(path, compression=None)
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in _record(row, date):
                    if data := press.compress(piece):
                        out.write(data)
                        at += len(data)
                data = press.flush()
                out.write(data)
                at, records = at + len(data), records + 1
                if at - begin >= RANGE_BYTES:
                    ranges.append((path, begin, at, records))
                    begin, records = at, 0
        if out:
            out.close()
            if records:
                ranges.append((path, begin, at, records))
        yield pd.DataFrame(ranges, columns=["path", "begin", "end", "records"])

    return write


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives to ``folder`` and returns their manifest."""
    rows = df.select(df[key].cast("bigint").alias("id"), F.coalesce(df[url], F.lit("")).alias("url"), F.coalesce(df[payload], F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1(F.col("payload").cast("binary"))})
    # only payloads that repeat have anything to learn from the join, and up to a counted size their digests are broadcast: no payload is shuffled
    repeated = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("many"))
    newest = stored(repeated.where("many > 1").select("digest", "newest"), "newest")
    newest = F.broadcast(newest) if newest.count() <= BROADCAST_KEYS else newest
    typed = rows.join(newest, "digest", "left").withColumn("refers_to", F.when(F.coalesce(F.col("id") != F.col("newest"), F.col("newest").isNotNull() & F.col("id").isNull()), F.col("newest")))
    typed = typed.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    return stored(typed.mapInPandas(_writer(folder, date), MANIFEST), "manifest")


class _Inflated:
    """A byte range of whole gzip members as a stream of inflated bytes."""

    def __init__(self, source, begin: int, end: int):
        source.seek(begin)
        self.source, self.left, self.raw, self.buffer = source, end - begin, b"", bytearray()
        self.press = zlib.decompressobj(31)

    def fill(self) -> bool:
        """Inflates one more block into the buffer; whether there was one."""
        if self.press.eof:
            self.raw, self.press = self.press.unused_data, zlib.decompressobj(31)
        if not self.raw:
            if not self.left:
                rest = self.press.flush()
                self.buffer += rest
                return bool(rest)
            self.raw = self.source.read(min(BLOCK, self.left))
            self.left -= len(self.raw)
            if not self.raw:
                raise ValueError("an archive is shorter than its manifest says")
        self.buffer += self.press.decompress(self.raw, BLOCK)
        self.raw = self.press.unconsumed_tail
        return True

    def header(self) -> list[str] | None:
        """Lines up to the next empty line; None at the end."""
        seen = 0
        while (at := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                return None
        lines = bytes(self.buffer[:at]).decode().split("\r\n")
        del self.buffer[: at + 4]
        return lines

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _number(name: str | None) -> int | None:
    tail = (name or "").strip("<>").removeprefix(NAME)
    return int(tail) if tail else None


def _chunks(store, path: str, begin: int, end: int, chunk_bytes: int) -> Iterator[tuple]:
    with store.open_input_file(path) as source:
        stream = _Inflated(source, begin, end)
        while (lines := stream.header()) is not None:
            record = _fields(lines)
            http_lines = stream.header()
            http = _fields(http_lines)
            left = int(record["content-length"]) - len("\r\n".join(http_lines).encode()) - 4
            declared = record["warc-payload-digest"].removeprefix("sha1:")
            fixed = (_number(record["warc-record-id"]), record["warc-target-uri"], record["warc-type"], _number(record.get("warc-refers-to")), int(http["content-length"]), declared)
            sha, total, no = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(chunk_bytes, left))
                if len(data) < min(chunk_bytes, left):
                    raise ValueError(f"{path}: a record ends early")
                left, total = left - len(data), total + len(data)
                sha.update(data)
                yield (*fixed, no, len(data), total, base64.b32encode(sha.digest()).decode(), not left, data)
                no += 1
                if not left:
                    break
            stream.take(4)


def _reader(folder: str, chunk_bytes: int, keep_data: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"record_id": "Int64", "refers_to": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path, begin, end in zip(pdf["path"], pdf["begin"], pdf["end"]):
                rows, held = [], 0
                for row in _chunks(store, path, int(begin), int(end), chunk_bytes):
                    rows.append(row if keep_data else (*row[:-1], None))
                    held += row[7] if keep_data else 200
                    if held >= BATCH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return read


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = BLOCK, keep_data: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest."""
    ranges = manifest.count()
    dealt = manifest.repartition(max(1, ranges), F.xxhash64("path", "begin"))
    return dealt.mapInPandas(_reader(folder, chunk_bytes, keep_data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact."""
    response = F.col("record_type") == "response"
    size = F.when(response, F.col("total_bytes")).otherwise(F.col("declared_bytes"))
    digest = F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest"))
    intact = ~response | ((F.col("total_bytes") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest")))
    return chunks.where("last").select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "url", intact.alias("intact"))


def round_trip(df: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row per record."""
    folder = f"{shared_dir(df.sparkSession)}/archives"
    return records(read_archives(write_archives(df, folder), folder, keep_data=False))
