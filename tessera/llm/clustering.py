"""Centroid clustering of embeddings by sort-means, in exact integers.

A round orders, for each centroid, the others by their distance from it. A vector starts at the centroid of its previous
assignment and scans the others in that order; it stops at one that lies strictly beyond twice its own distance, since
by the triangle inequality neither that one nor any later one can be nearer, or as near.

Assignments are state of the vectors' table, which is written every STEP rounds; in between, a task repeats the rounds
since then for its vectors, so no round depends on what an executor holds. What a round sends is a sum for each centroid
and component from each task; the driver holds centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, column, materialise

#: Rounds between two writings of the assignments.
STEP = 4
#: Components lie within this bound, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27


def integers(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors with exactly ``dim`` components, all finite.

    A component beyond LARGEST raises: its distances would not fit a long.
    """

    def run(parts):
        for batch in parts:
            rows = column(batch, "embedding")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(rows), dim), False))
            x = np.asarray(column(batch, "embedding").flatten().fill_null(np.nan)).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1)
            v = np.floor(x[good] * scale)
            if v.size and np.abs(v).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST / scale:g}: distances would not fit 64 bits")
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id").filter(pa.array(good)), _lists(v.astype(np.int32))], ["vec_id", "v"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return arrow(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), run, f"vec_id {kind}, v array<int>")


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(column(batch, "v").flatten()).reshape(-1, dim).astype(np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def scan(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number) and its squared distance, from the previous assignment."""
    between = np.stack([_squared(centroids, c) for c in centroids])
    order = np.argsort(between, axis=1, kind="stable")
    nearest, distance = previous.copy(), np.zeros(len(x), np.int64)
    for p in np.unique(previous):
        rows = np.flatnonzero(previous == p)
        own = _squared(x[rows], centroids[p])
        best, who = own.copy(), np.full(len(rows), p)
        open_ = np.arange(len(rows))
        for j in order[p][order[p] != p]:
            # squares: beyond twice the distance is more than four times its square
            open_ = open_[(between[p, j] + 3) // 4 <= own[open_]]
            if not len(open_):
                break
            d = _squared(x[rows[open_]], centroids[j])
            better = (d < best[open_]) | ((d == best[open_]) & (j < who[open_]))
            at = open_[better]
            best[at], who[at] = d[better], j
        nearest[rows], distance[rows] = who, best
    return nearest, distance


def _replayed(batch: pa.RecordBatch, history: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's vectors, their assignment after all rounds of ``history``, and its squared distances (0 without one)."""
    x = _matrix(batch, dim)
    at, distance = np.asarray(column(batch, "cluster")).astype(np.int64), np.zeros(len(x), np.int64)
    for c in history:
        at, distance = scan(x, at, c)
    return x, at, distance


def _assigned(state: DataFrame, history: list[np.ndarray], dim: int, keep: tuple[str, ...]) -> DataFrame:
    """Rows of the state with their assignment after ``history``: vec_id and ``keep`` of v, cluster and distance."""

    def run(parts):
        for batch in parts:
            _, at, distance = _replayed(batch, history, dim)
            have = {"v": lambda: column(batch, "v"), "cluster": lambda: pa.array(at.astype(np.int32)), "distance": lambda: pa.array(distance)}
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), *(have[k]() for k in keep)], ["vec_id", *keep])

    kinds = {"v": "array<int>", "cluster": "int", "distance": "long"}
    return arrow(state, run, ", ".join([f"vec_id {state.schema['vec_id'].dataType.simpleString()}", *(f"{k} {kinds[k]}" for k in keep)]))


def _means(state: DataFrame, history: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floors of the means of the vectors assigned after ``history``; empty ones stay."""
    k, dim = centroids.shape

    def run(parts):
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in parts:
            x, at, _ = _replayed(batch, history, dim)
            for j in np.unique(at):
                own = x[at == j]
                sums[j, :dim] += own.sum(axis=0)
                sums[j, dim] += len(own)
        if sums[:, dim].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], ["at", "s"])

    got = arrow(state, run, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(k * (dim + 1), np.int64)
    for r in got:
        sums[r["at"]] = r["s"]
    sums = sums.reshape(k, dim + 1)
    full = sums[:, dim] > 0
    out = centroids.copy()
    out[full] = sums[full, :dim] // sums[full, dim:]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id``. Each of ``rounds`` rounds assigns all
    vectors and replaces centroids by floors of means; a last assignment follows.

    Defined cases: a vector that is null, of another length, or with a null or non-finite component is left out; rows
    with equal vec_id are vectors of their own, their order as first centroids is that of their components; a null
    vec_id is a first centroid only where there are too few others; with fewer than k vectors each is a centroid; an
    empty table gives an empty one; components beyond LARGEST raise; further columns are ignored.
    """
    spark = vectors.sparkSession
    state = materialise(integers(vectors, dim, scale).withColumn("cluster", F.lit(0)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    history: list[np.ndarray] = []
    for i in range(1, rounds + 1 if len(centroids) else 1):
        history.append(centroids)
        if i % STEP == 0:
            state, history = materialise(_assigned(state, history, dim, ("v", "cluster"))), []
        centroids = _means(state, history, centroids)
    final = materialise(_assigned(state, history + ([centroids] if len(centroids) else []), dim, ("cluster", "distance")))
    sums = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, sums.get(j, 0), sum(sums.values()), digest[j]) for j in range(len(centroids))]
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
