"""Centroid clustering by Orchard's search (operator 13).

Lloyd's rounds over whole numbers: a component x counts as floor(scale * x).  The
first centroids are the vectors with the least hashes of their ids; a round
assigns every vector to its nearest centroid and moves each centroid to the
floor of its vectors' mean.

The nearest centroid is found by Orchard's search.  Every centroid has the list
of all centroids by their distance from it.  A vector goes along the list of the
best centroid so far and marks what it has visited; when it finds a closer one,
it jumps to that one's list; it stops when the next centroid in the list is
strictly farther from the best one than twice the vector's own distance, since
none behind it can be as near.  All vectors of a batch go on together, in numpy.

A round shuffles one row of sums for each task and centroid; only centroids and
those sums, whose number does not grow with the vectors, reach the driver.

Defined results: vectors that are null, or hold another number of components
than ``dims``, nulls or values that are not finite take no part.  Ties go to the
smaller number.  Components are held to 2 ** 26 in size, so that distances
fit 64 bits.  Repeated rows are vectors of their own, a null id hashes as the
word null; other columns are ignored; an empty table gives no rows, and fewer
vectors than centroids give so many centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Largest size of a component.
BOUND = 1 << 26


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the whole numbers of every vector that takes part."""
    x = F.col("embedding")
    fits = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(fits, F.lit(False)))

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            v = np.clip(np.floor(np.clip(flat, -1e300, 1e300) * scale), -BOUND, BOUND).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, dims), pa.int32()), v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "v"])

    return rows.mapInArrow(rounded, "vec_id long, v array<long>")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x and its squared distance, by Orchard's search."""
    k, n = len(centroids), len(x)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    lists = np.argsort(apart, axis=1, kind="stable")
    best, distance = np.zeros(n, np.int64), ((x - centroids[0]) ** 2).sum(axis=1)
    visited, place = np.zeros((n, k), bool), np.zeros(n, np.int64)
    visited[:, 0] = True
    going = np.arange(n)
    while len(going):
        mine = best[going]
        other = lists[mine, place[going]]
        on = apart[mine, other] <= 4 * distance[going]  # squared: not beyond twice the distance
        going, mine, other = going[on], mine[on], other[on]
        new = ~visited[going, other]
        place[going] += 1
        at, other, mine = going[new], other[new], mine[new]
        visited[at, other] = True
        found = ((x[at] - centroids[other]) ** 2).sum(axis=1)
        closer = (found < distance[at]) | (found == distance[at]) & (other < mine)
        jump = at[closer]
        best[jump], distance[jump], place[jump] = other[closer], found[closer], 0
        going = going[place[going] < k]
    return best, distance


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means; one without vectors stays."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            best, _ = nearest(x, centroids)
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), *(pa.array(total[held, i]) for i in range(dims))], ["cluster", "n", *(f"s{i}" for i in range(dims))])

    parts = rows.mapInArrow(sums, ", ".join(["cluster int", "n long", *(f"s{i} long" for i in range(dims))]))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(exact(f"s{i}") for i in range(dims))).collect():  # k rows at most
        moved[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(dims)]
    return moved


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids, behind the seed, have the least SHA-256; ties by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.v for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, dims, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], names)
    for _ in range(rounds):
        centroids = _moved(rows, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_matrix(batch, dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = written(rows.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), digest[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
