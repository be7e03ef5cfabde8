"""Approximate nearest neighbours by an inverted multi-index (operator 6).

Both halves of the vectors are quantised by k-means of their own; a vector's
cell is its pair of centroids.  For a query, the pairs are visited by the sum
of their distances, with a heap, until enough entries are gathered; the entries
of those cells are reranked by the exact Euclidean distance.

The centroids are fitted on at most ``MAX_FIT`` vectors; every vector is
indexed.  Entries lie in lists by first centroid; a query is sent once to each
list it visits, with the second centroids it wants there.  Long lists (one
vector may be very common) are cut into parts, and a crowded cell counts
towards a query's entries only as ``CROWDED`` times the mean cell, so that it
does not end the search.  A part's entries are held in memory, and queries pass
by in batches, however many there are.

How many entries are gathered is measured on each table: of at most ``TRIED`` of
its vectors the exact neighbours are found in one pass, and the share of entries
is taken by which ``FOUND`` of them would have been met.  Vectors without
structure, whose neighbours are hardly nearer than others, need a third of all
entries and more; clustered ones need few.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; repeated rows are entries of
their own, but a query never finds its own id; equal distances go by the
smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import sample

MAX_FIT = 20_000
#: Entries a cell should hold on average, and the most centroids of a half.
PER_CELL, MAX_CENTROIDS = 3, 256
#: Vectors whose exact neighbours set the share of entries that queries gather, and the part of these that must be met by it.
TRIED, FOUND = 256, 0.98
CROWDED = 4
#: Entries of a part of a list: twice the mean list, within these bounds.
PART = (256, 65_536)
K = 10


def usable(vectors: DataFrame, length: int | None = None, column: str = "embedding") -> tuple[DataFrame, int]:
    """The vectors that take part, and their length: that of most of them, if it is not given."""
    v = F.col(column)
    plain = vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    if length is None:
        most = plain.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        length = most[0].n if most else 0
    return plain.where(F.size(v) == length), length


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    x = x.astype(np.float32)
    centroids = np.unique(x, axis=0)
    centroids = centroids[np.random.default_rng(seed).permutation(len(centroids))[:k]]
    for _ in range(rounds):
        nearest = _distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1))


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # entries by first and second centroid
    part: int
    share: float = 1.0  # of entries that a query gathers

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return _distances(x[:, :h], self.first), _distances(x[:, h:], self.second)

    def parts(self) -> np.ndarray:
        """Parts of each list."""
        return np.maximum(1, -(-self.counts.sum(1) // self.part))

    def weight(self) -> np.ndarray:
        """What each cell counts towards a query's entries."""
        occupied = self.counts[self.counts > 0]
        return np.minimum(self.counts, max(1, int(CROWDED * occupied.mean())))

    def probes(self, x: np.ndarray) -> Iterator[dict[int, list[int]]]:
        """For each row, the cells to visit: second centroids by first centroid."""
        weight = self.weight()
        goal = self.share * weight.sum()
        weight = weight.tolist()
        for a, b in zip(*self.halves(x)):
            i, j = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
            a, b, found, gathered = a[i].tolist(), b[j].tolist(), {}, 0
            heap = [(a[0] + b[0], 0, 0)]
            while heap and gathered < goal:
                _, p, q = heapq.heappop(heap)
                if n := weight[i[p]][j[q]]:
                    found.setdefault(i[p], []).append(j[q])
                    gathered += n
                if q + 1 < len(b):
                    heapq.heappush(heap, (a[p] + b[q + 1], p, q + 1))
                if q == 0 and p + 1 < len(a):  # each row of pairs starts when the one before has
                    heapq.heappush(heap, (a[p + 1] + b[0], p + 1, 0))
            yield found

    def needed(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The share of entries that a query x[i] must gather to get as far as the cell cells[i] (list, cell)."""
        weight = self.weight()
        out = np.empty(len(x))
        for k, (a, b, (i, j)) in enumerate(zip(*self.halves(x), cells)):
            before = a[:, None] + b < a[i] + b[j]
            out[k] = (weight[before].sum() + weight[i, j]) / weight.sum()
        return out


def build(vectors: DataFrame, k: int = K) -> MultiIndex | None:
    """From usable vectors (vec_id, embedding)."""
    n = vectors.count()
    if not n:
        return None
    x = matrix(sample(vectors, MAX_FIT, "vec_id").toArrow().column("embedding").combine_chunks())
    h = x.shape[1] // 2
    size = int(min(MAX_CENTROIDS, max(2, round((n / PER_CELL) ** 0.5))))
    first, second = k_means(x[:, :h], size), k_means(x[:, h:], size)
    index = MultiIndex(first, second, np.zeros((len(first), len(second)), np.int64), int(np.clip(2 * n // size, *PART)))
    for r in entries(vectors, index).groupBy("list", "cell").count().collect():  # as many rows as centroid pairs at most
        index.counts[r.list, r.cell] = r["count"]
    index.share = enough(vectors, index, k)
    return index


def enough(vectors: DataFrame, index: MultiIndex, k: int = K) -> float:
    """The share of entries by which FOUND of the exact neighbours of at most TRIED vectors are met."""
    tried = sample(vectors, TRIED, "vec_id").toArrow()
    ids, x = tried.column("vec_id").to_numpy(), matrix(tried.column("embedding").combine_chunks())
    exact = nearest(vectors, ids, x, k).collect()  # TRIED times k rows at most
    if not exact:
        return 1.0
    near = matrix(pa.array([r.embedding for r in exact]))
    a, b = index.halves(near)
    at = np.array([r.row for r in exact])
    return float(min(1.0, np.quantile(index.needed(x[at], np.stack([a.argmin(1), b.argmin(1)], 1)), FOUND, method="higher")))


def nearest(vectors: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """row and embedding of the exact k nearest vectors of each x[row], without those of its id; each task hands on its own k nearest."""
    held = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = held.value
        far, vector = np.zeros((len(x), 0)), np.zeros((len(x), 0, x.shape[1]))
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = batch.slice(a, 2048)
                y = matrix(some.column("embedding"))
                d = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)
                d[some.column("vec_id").to_numpy() == ids[:, None]] = np.inf
                top = np.argpartition(d, min(k, len(y)) - 1, axis=1)[:, :k]
                far, vector = np.concatenate([far, np.take_along_axis(d, top, 1)], 1), np.concatenate([vector, y[top]], 1)
                order = np.argsort(far, axis=1, kind="stable")[:, :k]
                far, vector = np.take_along_axis(far, order, 1), np.take_along_axis(vector, order[:, :, None], 1)
        row, at = np.nonzero(np.isfinite(far))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * x.shape[1], pa.int32()), vector[row, at].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(far[row, at]), lists], ["row", "d", "embedding"])

    parts = vectors.select("vec_id", "embedding").mapInArrow(best, "row int, d double, embedding array<double>")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("d", "embedding")))
    return ranked.where(F.col("rank") <= k).select("row", "embedding")


def entries(vectors: DataFrame, index: MultiIndex) -> DataFrame:
    """vec_id, embedding, and the list, second centroid (cell) and part of each vector."""
    held = vectors.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            if batch.num_rows:
                a, b = index.halves(matrix(batch.column("embedding")))
                row = a.argmin(1)
                ids = batch.column("vec_id").to_numpy()
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.parts()[row]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row.astype(np.int64)), pa.array(part), pa.array(b.argmin(1).astype(np.int64))], ["vec_id", "embedding", "list", "part", "cell"])

    return vectors.select("vec_id", "embedding").mapInArrow(assign, f"vec_id long, embedding {_kind(vectors)}, list long, part long, cell long")


def _kind(vectors: DataFrame) -> str:
    """Vectors move as they are; distances are taken in double precision."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest entries found.

    vectors has vec_id and embedding; queries has query_id and embedding.
    """
    kind = _kind(vectors)
    vectors, length = usable(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).where("vec_id is not null"))
    queries, _ = usable(queries.select(F.col("query_id").cast("long"), F.col("embedding").cast(kind)), length)
    index = build(vectors, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = vectors.sparkSession.sparkContext.broadcast(index)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        parts = index.parts().tolist()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                out = [(row, which, part, cells) for row, found in enumerate(index.probes(matrix(some.column("embedding")))) for which, cells in found.items() for part in range(parts[which])]
                rows, lists, at, cells = zip(*out) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [*some.take(pa.array(rows, pa.int64())).columns, pa.array(lists, pa.int64()), pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.int16()))],
                    ["query_id", "embedding", "list", "part", "cells"],
                )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, its entries before the queries that visit it."""
        key, parts, x, ids, cell = None, [], None, None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("list", "part", "side")], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if key != tuple(place[a, :2]):
                    key, parts, x = tuple(place[a, :2]), [], None
                if place[a, 2] == 0:
                    parts.append((some.column("id").to_numpy(), matrix(some.column("embedding")), some.column("cell").to_numpy(zero_copy_only=False)))
                elif parts:
                    if x is None:
                        ids, x, cell = (np.concatenate(c) for c in zip(*parts))
                    for own, v, cells in zip(some.column("id").to_numpy(), matrix(some.column("embedding")), some.column("cells")):
                        wanted = np.zeros(len(index.second), bool)
                        wanted[cells.values.to_numpy()] = True
                        chosen = np.flatnonzero(wanted[cell] & (ids != own))
                        d = np.sqrt(((x[chosen] - v) ** 2).sum(1))
                        best = np.lexsort((ids[chosen], d))[:k]
                        out.append((np.full(len(best), own), ids[chosen][best], d[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    placed = queries.mapInArrow(visit, f"query_id long, embedding {kind}, list long, part long, cells array<smallint>")
    none = lambda t: F.lit(None).cast(t)
    each = entries(vectors, index).select("list", "part", F.lit(0).alias("side"), F.col("vec_id").alias("id"), "embedding", "cell", none("array<smallint>").alias("cells")).unionByName(
        placed.select("list", "part", F.lit(1).alias("side"), F.col("query_id").alias("id"), "embedding", none("long").alias("cell"), "cells"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartition(n, "list", "part").sortWithinPartitions("list", "part", "side")
    near = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
