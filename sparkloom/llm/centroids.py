"""Centroid clustering of integer vectors: Lloyd's rounds in Spark, nearest centroids by partial-distance search.

Every vector becomes integers once and is staged. A round maps each batch of vectors to its nearest centroids and keeps,
for each task, the sums and counts of ``k`` clusters; Spark adds these up, and what reaches the driver is ``k * dims`` sums,
however many vectors there are. The next centroids are exact floors of Python integers.

The search adds up squared differences over the dimensions of highest variance first, ``STEP`` dimensions at a time. A
vector leaves a centroid's list as soon as its partial distance is strictly above its best so far; those that remain have
been through all dimensions, and their distance is exact. Variances come from all vectors; they set the order of the work and
nothing of the result.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows
count each time; integers are bounded by 2^27 in size so that a squared distance is a long (components beyond 2^17 at the
scale of 1024 take the bound); equal distances go to the smaller number; rows without an id, or with an id that is no whole
number, are clustered, have a null id, and start a centroid only after all others; of rows with one id the smaller vector
starts first; fewer vectors than centroids make fewer centroids; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import long_id, small_batches, stage

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Dimensions that are added up between two looks at the best distance.
STEP = 8
#: Integers beyond take this bound; 64 squared differences of twice as much still fit into a long.
BOUND = 1 << 27


def _usable(dims: int) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col("v").isNotNull() & (F.size("v") == dims) & ~F.exists("v", odd)


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, q array<int>: the usable vectors, each component x as floor(scale * x)."""
    rows = vectors.select(long_id(vectors[id_column]).alias("vec_id"), vectors[vector_column].cast("array<double>").alias("v"))
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * F.lit(float(scale))), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return rows.where(_usable(dims)).select("vec_id", whole.alias("q"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of ``x``; dimensions are visited in ``order``."""
    x, centroids = x[:, order], centroids[:, order]
    label = np.zeros(len(x), np.int64)
    best = ((x - centroids[0]) ** 2).sum(axis=1)
    for c in range(1, len(centroids)):
        alive, partial = np.arange(len(x)), np.zeros(len(x), np.int64)
        for lo in range(0, x.shape[1], step):
            partial = partial + ((x[alive, lo : lo + step] - centroids[c, lo : lo + step]) ** 2).sum(axis=1)
            hold = partial <= best[alive]
            alive, partial = alive[hold], partial[hold]
            if not len(alive):
                break
        closer = partial < best[alive]
        best[alive[closer]], label[alive[closer]] = partial[closer], c
    return label, best


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[list[int], list[list[int]], np.ndarray]:
    """Count, componentwise sum and (roughly) sum of squares of each cluster; a task sends one row for each of ``k * dims``."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims))
        for batch in batches:
            x = _matrix(batch, dims)
            label, _ = nearest(x, centroids, order)
            n += np.bincount(label, minlength=k)
            for c in np.unique(label):
                total[c] += x[label == c].sum(axis=0)
                squares[c] += (x[label == c].astype(float) ** 2).sum(axis=0)
        if n.any():
            cluster, dim = np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(dim), pa.array(np.repeat(n, dims)), pa.array(total.ravel()), pa.array(squares.ravel())], ["cluster", "dim", "n", "total", "squares"])

    parts = vectors.select("q").mapInArrow(run, "cluster long, dim long, n long, total long, squares double")
    count, total, squares = [0] * k, [[0] * dims for _ in range(k)], np.zeros((k, dims))
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect():
        count[r["cluster"]], total[r["cluster"]][r["dim"]], squares[r["cluster"], r["dim"]] = r["n"], r["total"], r["squares"]
    return count, total, squares


def _starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(digest.alias("digest"), "q").orderBy(F.col("digest").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after ``rounds`` rounds over quantised, staged vectors, and the dimensions by falling variance."""
    centroids = _starts(vectors, k, seed)
    if not len(centroids):
        return centroids, np.zeros(0, np.int64)
    dims = centroids.shape[1]
    (n,), (total,), squares = _sums(vectors, centroids[:1], np.arange(dims))
    mean = np.array(total, float) / n
    order = np.argsort(-(squares[0] / n - mean**2), kind="stable")
    for _ in range(rounds):
        count, total, _ = _sums(vectors, centroids, order)
        centroids = np.array([[t // n for t in row] if n else old for n, row, old in zip(count, total, centroids.tolist(), strict=True)], np.int64)
    return centroids, order


def assign(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of quantised vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance = nearest(_matrix(batch, centroids.shape[1]), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid (array<long>) for each usable vector."""
    spark = vectors.sparkSession
    small_batches(spark)
    held = stage(quantised(vectors, dims, scale, id_column, vector_column), "quantised")
    centroids, order = fit(held, k, rounds, seed)
    ddl = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not len(centroids):
        return spark.createDataFrame([], ddl)
    placed = stage(assign(held, centroids, order), "clusters")
    inertia = {r["cluster"]: r["sum"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    every = sum(inertia.values())
    named = [(c, inertia.get(c, 0), every, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(), row) for c, row in enumerate(centroids.tolist())]
    of = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return placed.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
