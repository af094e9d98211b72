"""Centroid clustering of integer vectors by scalar lookup tables.

A component x becomes the integer floor(scale * x). In a round, every block of vectors tabulates for each dimension
the squared difference of each occurring integer to each centroid; distances are gathers from these tables and
their sums, all in integers, so that results do not depend on how rows are dealt out. Centroids (k x dims
integers) go to the tasks with their function; a task returns its sums by cluster and dimension, which
Spark adds up: k x dims rows of a round reach the driver, whatever the number of vectors.

Edge cases: vectors that are missing, have another number of components, or a missing or non-finite one are left
out, as are those with an integer beyond +-2**27, whose squared distance may not fit a long. Fewer kept vectors
than ``k`` give as many centroids. Vectors without an id are clustered, but start no centroid. Rows that repeat an id
are clustered each; of equal hashes the smaller vector starts first. Ties of distance go to the smaller number.
A sum of distances beyond a long is missing. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

K = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = 1
FAR = 1 << 27
BLOCK = 8192  # vectors that are looked up at a time
_WIDE = "decimal(38,0)"


class Clusters(NamedTuple):
    """Rows (id, cluster, distance) of a written table, and the final centroids in order."""

    rows: DataFrame
    centroids: list[list[int]]


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v array<int>) of the vectors that are kept."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    sound = F.forall(
        F.col(vector_col),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * F.lit(float(scale))) < FAR),
    )
    kept = vectors.where(F.size(vector_col) == dims).where(sound)
    return kept.select(F.col(id_col).alias("id"), whole.cast("array<int>").alias("v"))


def _seeds(table: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes, in ascending order of these."""
    key = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), "UTF-8"), 256)
    first = table.where("id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(k)
    return [list(r.v) for r in first.collect()]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equal ones) and squared distance of every row."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        occurring, place = np.unique(vectors[:, d], return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    """(ids, vectors) of at most ``BLOCK`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _sums(table: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(number of vectors, sum of the component) by cluster and dimension; clusters without vectors are missing."""
    own = np.array(centroids, np.int64)
    k, dims = own.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, vectors in _blocks(batches, dims):
            best, _ = nearest(vectors, own)
            count += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total[c] += vectors[best == c].sum(axis=0)
        used = np.flatnonzero(count)
        cluster, dim = np.repeat(used, dims), np.tile(np.arange(dims), len(used))
        cols = [cluster.astype(np.int32), dim.astype(np.int32), count[cluster], total[cluster, dim]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cluster", "dim", "n", "s"])

    partial = table.mapInArrow(run, "cluster int, dim int, n long, s long")
    added = partial.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast(_WIDE)).alias("n"), F.sum(F.col("s").cast(_WIDE)).alias("s"))
    return {(r.cluster, r.dim): (int(r.n), int(r.s)) for r in added.collect()}


def _assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    own = np.array(centroids, np.int64)
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches, own.shape[1]):
            best, distance = nearest(vectors, own)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return table.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
) -> Clusters:
    """Clusters of the kept vectors after ``rounds`` rounds and one more assignment."""
    table = stage(integers(vectors, id_col, vector_col, dims, scale), "vectors")
    centroids = _seeds(table, k, seed)
    if not centroids:
        kind = table.schema["id"].dataType.simpleString()
        return Clusters(table.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), [])
    for _ in range(rounds):
        found = _sums(table, centroids)
        for c in {c for c, _ in found}:
            centroids[c] = [found[c, d][1] // found[c, d][0] for d in range(dims)]
    return Clusters(stage(_assigned(table, centroids), "clusters"), centroids)


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def report(found: Clusters, id_col: str = "vec_id") -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_cluster of every vector."""
    rows, centroids = found
    wide = F.sum(F.col("distance").cast(_WIDE)).alias("s")
    sums = {r.cluster: r for r in rows.groupBy("cluster").agg(wide, F.count("*").alias("n")).collect()}
    own = [int(sums[c].s) if c in sums else 0 for c in range(len(centroids))] or [0]
    sizes = [sums[c].n if c in sums else 0 for c in range(len(centroids))] or [0]
    fits = [s if s < 1 << 63 else None for s in (*own, sum(own))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    return rows.select(
        F.col("id").alias(id_col), "cluster", "distance",
        _by_cluster(fits[:-1], "long").alias("cluster_inertia"), F.lit(fits[-1]).cast("long").alias("inertia"),
        _by_cluster(names, "string").alias("centroid_sha256"), _by_cluster(sizes, "long").alias("n_cluster"),
    )
