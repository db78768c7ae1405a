"""Keyed tables: upserts that write the batch and not the table.

A table is a folder of hash buckets of its keys. An upsert writes its rows, dealt to their buckets, as a delta of a new version and then
commits the version by one small manifest file, which appears by a rename: a version without a manifest was cut off and is never read, and
the next upsert takes another folder. A read resolves the deltas by key, bucket by bucket. :func:`compact` joins the deltas of the buckets
that have many of them and leaves the others alone.

Three kinds of writes, as an embedded database has them:

- ``replace``: the row takes the place of any with its keys,
- ``ignore``: the row counts only where no row has its keys,
- ``update``: like replace, but columns that the batch lacks keep what they had.

Several rows of a batch with equal keys: the one with the largest ``order`` columns counts (the smallest for ``ignore``), ties fall to the
larger (smaller) row. Keys may be null; null equals null. An empty batch commits a version without files. One writer at a time is assumed; a
second one that tries to commit the same version fails at the rename.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("replace", "ignore", "update")
MANIFESTS, DATA = "_versions", "data"


@dataclass(frozen=True)
class Version:
    """What a manifest says: the live folders with the buckets that each still counts for (None: all), and the number of buckets."""

    number: int
    buckets: int
    folders: dict[str, list[int] | None] = field(default_factory=dict)


class KeyedTable:
    """A keyed table under ``path`` (an address that Spark can read), with the columns of ``schema`` and the key columns ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.values = [c for c in self.schema.names if c not in keys]
        inner = [T.StructField("_version", T.LongType()), T.StructField("_kind", T.StringType()), T.StructField("_set", T.ArrayType(T.StringType())), T.StructField("_bucket", T.IntegerType())]
        self.stored_schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema), *inner])
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _manifest(self, number: int) -> str:
        return f"{self.path}/{MANIFESTS}/{number:012d}.json"

    def version(self) -> Version:
        """The last committed version; 0 before the first."""
        folder = self._path(f"{self.path}/{MANIFESTS}")
        names = [s.getPath().getName() for s in self._store.listStatus(folder)] if self._store.exists(folder) else []
        done = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not done:
            return Version(0, self.buckets)
        text = self.spark.read.text(f"{self.path}/{MANIFESTS}/{done[-1]}", wholetext=True).head()[0]
        return Version(**json.loads(text))

    def _commit(self, version: Version) -> None:
        hidden = self._path(f"{self.path}/{MANIFESTS}/.{uuid.uuid4().hex}")
        out = self._store.create(hidden)
        out.write(bytearray(json.dumps({"number": version.number, "buckets": version.buckets, "folders": version.folders}).encode()))
        out.close()
        if not self._store.rename(hidden, self._path(self._manifest(version.number))):
            self._store.delete(hidden, False)
            raise RuntimeError(f"version {version.number} of {self.path} is another writer's")

    # writes

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{DATA}/{name}")
        return name

    def upsert(self, batch: DataFrame, kind: str = "replace", order: list[str] | None = None) -> Version:
        """Writes a batch; columns of the table that it lacks are null, or stay as they were for ``update``."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind of write {kind}; there are {', '.join(KINDS)}")
        if missing := [k for k in self.keys if k not in batch.columns]:
            raise ValueError(f"a batch needs its keys {', '.join(missing)}")
        last = self.version()
        given = [c for c in self.values if c in batch.columns]
        columns = [F.col(f.name).cast(f.dataType) if f.name in batch.columns else F.lit(None).cast(f.dataType) for f in self.schema]
        rank = F.struct(*(F.col(c) for c in order or []), F.struct(*(F.col(f"_row.{c}") for c in given)))
        rows = batch.select(*(batch[c] for c in order or [] if c not in self.schema.names), *(c.alias(f.name) for c, f in zip(columns, self.schema)))
        rows = rows.withColumn("_row", F.struct(*self.schema.names))
        pick = F.min_by if kind == "ignore" else F.max_by
        # a batch has one row for each of its keys from here on
        rows = rows.groupBy(*(F.col(k).alias(f"_key_{k}") for k in self.keys)).agg(pick("_row", rank).alias("_row")).select("_row.*")
        marks = {"_version": F.lit(last.number + 1).cast("long"), "_kind": F.lit(kind), "_set": F.array(*map(F.lit, given)).cast("array<string>"), "_bucket": self._bucket(last.buckets)}
        name = self._write(rows.withColumns(marks).repartition(last.buckets, "_bucket"))
        version = Version(last.number + 1, last.buckets, {**last.folders, name: None})
        self._commit(version)
        return version

    # reads

    def _deltas(self, version: Version) -> DataFrame | None:
        parts = []
        for name, buckets in version.folders.items():
            if buckets == [] or not self._has_files(name):
                continue
            df = self.spark.read.schema(self.stored_schema).parquet(f"{self.path}/{DATA}/{name}")
            parts.append(df if buckets is None else df.where(F.col("_bucket").isin(*buckets)))
        out = None
        for df in parts:
            out = df if out is None else out.unionByName(df)
        return out

    def _has_files(self, name: str) -> bool:
        return any(s.getPath().getName().startswith("_bucket=") for s in self._store.listStatus(self._path(f"{self.path}/{DATA}/{name}")))

    def _resolved(self, deltas: DataFrame) -> DataFrame:
        """One row for each key: all its writes in order of version, folded column by column."""
        version = F.col("_version")
        changes = F.col("_kind") != "ignore"
        began, offered = F.min(F.when(changes, version)), F.min(F.when(~changes, version))
        first_counts = began.isNull() | (offered < began)  # an `ignore` counts if nothing was there before it
        out = []
        for c in self.values:
            box = F.struct(F.col(c))
            sets = changes & ((F.col("_kind") == "replace") | F.array_contains("_set", c))
            last = F.max_by(F.when(F.array_contains("_set", c), box).otherwise(F.struct(F.lit(None).cast(self.schema[c].dataType).alias(c))), F.when(sets, version))
            first = F.min_by(box, F.when(~changes, version))
            out.append(F.when(F.count_if(sets) > 0, last[c]).when(first_counts, first[c]).alias(c))
        return deltas.groupBy("_bucket", *self.keys).agg(*out, F.max("_version").alias("_version"))

    def read(self, version: Version | None = None) -> DataFrame:
        """The table's rows; filters on keys reach the files."""
        deltas = self._deltas(version or self.version())
        if deltas is None:
            return self.spark.createDataFrame([], self.schema)
        return self._resolved(deltas).select(*self.schema.names)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys are in ``wanted``."""
        rows = self.read()
        right = wanted.select(*(F.col(k).alias(f"_wanted_{k}") for k in self.keys)).distinct()
        same = [rows[k].eqNullSafe(right[f"_wanted_{k}"]) for k in self.keys]
        return rows.join(right, same, "left_semi")

    # compaction

    def compact(self, most: int = 4) -> Version:
        """Buckets with more than ``most`` deltas get one; no other bucket is read or written. Files that nothing names any more are left for :meth:`clean`."""
        last = self.version()
        held: dict[int, list[str]] = {}
        for name, buckets in last.folders.items():
            for s in self._store.listStatus(self._path(f"{self.path}/{DATA}/{name}")):
                found = s.getPath().getName()
                if found.startswith("_bucket=") and (buckets is None or int(found[8:]) in buckets):
                    held.setdefault(int(found[8:]), []).append(name)
        crowded = sorted(b for b, names in held.items() if len(names) > most)
        if not crowded:
            return last
        rows = self._resolved(self._deltas(last).where(F.col("_bucket").isin(*crowded)))
        marks = {"_kind": F.lit("replace"), "_set": F.array(*map(F.lit, self.values)).cast("array<string>")}
        name = self._write(rows.withColumns(marks).select(*self.stored_schema.names).repartition(len(crowded), "_bucket"))
        rest = {n: [b for b, names in held.items() if n in names and b not in crowded] for n in last.folders}
        version = Version(last.number + 1, last.buckets, {n: sorted(b) for n, b in rest.items() if b} | {name: None})
        self._commit(version)
        return version

    def clean(self) -> int:
        """Removes folders that the last version does not name: cut-off writes and compacted deltas. Not while others read or write."""
        live, gone = self.version().folders, 0
        folder = self._path(f"{self.path}/{DATA}")
        for s in self._store.listStatus(folder) if self._store.exists(folder) else []:
            if s.getPath().getName() not in live:
                self._store.delete(s.getPath(), True)
                gone += 1
        return gone
