"""Centroid clustering with Orchard's search: exact nearest centroids of whole-number vectors, some rounds of Lloyd's method.

A vector is searched from one centroid's neighbour list: the other centroids in order of their distance to it. A centroid that is closer to
the vector than the best so far (or as close, with a smaller number) becomes the best, and its own list goes on; those seen before are marked
and cost nothing. A neighbour that is strictly more than twice as far from the best as the vector is ends the search: by the triangle
inequality neither it nor any later one can be as close. The lists hold k x k whole numbers, k being a parameter.

Edge cases: a vector is kept if it has exactly ``size`` components, none of them null, NaN or infinite; others have no row. A null id counts
as empty text where ids are hashed. Repeated ids are rows of their own; vectors with the same id start in order of their components. Fewer than
``k`` kept vectors are so many centroids; without any the result is empty. Components so large (2^18 for 64 of
them) that squared distances could pass 64 bits are an error. Further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadforge.llm.common import stored

#: Parts of a unit that components are floored to.
SCALE = 256


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(id, v): ids and floored whole components of the vectors that are kept."""
    v = F.col("v")
    largest = math.isqrt(2**60 // size) // 2  # four squared distances fit 64 bits
    some = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("v"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return some.where(F.coalesce((F.size(v) == size) & whole, F.lit(False))).select(
        "id", F.transform(v, lambda x: F.when(F.abs(x) * SCALE <= largest, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large: squared distances would pass 64 bits"))).cast("int")).alias("v")
    )


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance (ties: smaller number), and their squared distances."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(between, -1)
    lists = np.argsort(between, axis=1, kind="stable")[:, 1:]
    return lists, np.take_along_axis(between, lists, axis=1)


def orchard(vectors: np.ndarray, centroids: np.ndarray, lists: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and the squared distance. All vectors walk at once, each on its own list."""
    n, k = len(vectors), len(centroids)
    best = np.zeros(n, np.int64)
    distance = ((vectors - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    place = np.zeros(n, np.int64)
    walking = np.arange(n if k > 1 else 0)
    while len(walking):
        b, p = best[walking], place[walking]
        open_ = gaps[b, p] <= 4 * distance[walking]  # squared: strictly beyond twice the distance ends
        walking, b, p = walking[open_], b[open_], p[open_]
        other = lists[b, p]
        place[walking] += 1
        new = ~seen[walking, other]
        w, o = walking[new], other[new]
        seen[w, o] = True
        d = ((vectors[w] - centroids[o]) ** 2).sum(axis=1)
        closer = (d < distance[w]) | ((d == distance[w]) & (o < best[w]))
        w, o = w[closer], o[closer]
        best[w], distance[w], place[w] = o, d[closer], 0
        walking = walking[place[walking] < k - 1]
    return best, distance


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means, floored, of the vectors nearest to each centroid; an empty centroid stays. A task passes on one row for each centroid of a batch."""
    lists, gaps = neighbours(centroids)
    size = centroids.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for pdf in batches:
            if len(pdf):
                v = _stacked(pdf["v"])
                best, _ = orchard(v, centroids, lists, gaps)
                np.add.at(total, best, v)
                count += np.bincount(best, minlength=len(centroids))
        met = count.nonzero()[0]
        yield pd.DataFrame({"c": met, "n": count[met]} | {f"s{i}": total[met, i] for i in range(size)})

    schema = "c bigint, n bigint, " + ", ".join(f"s{i} bigint" for i in range(size))
    parts = vectors.select("v").mapInPandas(sums, schema).groupBy("c").agg(*(F.sum(x).alias(x) for x in ["n", *(f"s{i}" for i in range(size))]))
    out = centroids.copy()
    for row in parts.collect():  # a row for each centroid
        out[row["c"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, seed: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): every kept vector with its nearest centroid after ``rounds`` rounds.

    Centroids start as the ``k`` vectors whose ``seed`` and id have the smallest SHA-256. ``centroid`` holds the final components.
    """
    spark = df.sparkSession
    vectors = stored(kept_vectors(df, id_col, vector_col, size), "vectors")
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(hashed, "v").limit(k).collect()
    id_type = vectors.schema["id"].dataType.simpleString()
    result = f"id {id_type}, cluster int, distance bigint"
    if not first:
        return spark.createDataFrame([], f"{result}, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    centroids = np.array([row["v"] for row in first], np.int64)
    for _ in range(rounds):
        centroids = _centroids(vectors, centroids)
    lists, gaps = neighbours(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                best, distance = orchard(_stacked(pdf["v"]), centroids, lists, gaps)
                yield pd.DataFrame({"id": pdf["id"], "cluster": best, "distance": distance})

    rows = stored(vectors.mapInPandas(assign, result), "assigned")
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    notes = [(c, sums.get(c, 0), sum(sums.values()), [int(x) for x in centroids[c]]) for c in range(len(centroids))]
    notes = spark.createDataFrame(notes, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return rows.join(F.broadcast(notes), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows are broadcast
