"""Nearest neighbours by cosine through an inverted multi-index.

Unit vectors are cut in two halves, and each half is quantised by centroids of its own; an entry's cell is its pair of centroids.
For a query the pairs are taken in order of their summed distance by a heap, and the entries of the cells so reached are compared with
it in full. How far a search goes is a share of all entries, learnt with the centroids on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .frames import written
from .vectors import finite, matrix, of_one_length

#: Rows on which centroids and reach are learnt, and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 500
#: Entries and queries that one task compares at once, and the least number of entries a search meets.
PIECE_ENTRIES, PIECE_QUERIES, LEAST_ENTRIES = 4_096, 4_096, 64
MOST_CENTROIDS = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two taken out first keeps squares within range and changes no digit."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with that row of ``y``; equal rows have equal results, whatever their places."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None]) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None]


def fitted_centroids(x: np.ndarray, number: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``, started at rows of it."""
    centroids = x[np.random.default_rng(0).permutation(len(x))[:number]]
    for _ in range(rounds):
        own = distances(x, centroids).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        held = np.bincount(own, minlength=len(centroids))
        used = np.flatnonzero(held)
        sums = np.add.reduceat(x[order], (np.cumsum(held) - held)[used], axis=0)
        centroids = centroids.copy()
        centroids[used] = sums / held[used, None]
    return centroids


@dataclass
class MultiIndex:
    """Centroids of both halves, and the share of all entries that a search meets."""

    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both centroids of each unit vector."""
        return distances(x[:, : self.half], self.first).argmin(axis=1), distances(x[:, self.half :], self.second).argmin(axis=1)

    def turns(self, x: np.ndarray) -> np.ndarray:
        """For each unit vector the rank of each second centroid, the nearest first, as ``reach`` has it."""
        order = np.stack([np.argsort(distances(q[None, self.half :], self.second)[0], kind="stable") for q in x])
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None].repeat(len(order), 0), axis=1)
        return out

    def reach(self, query: np.ndarray, held: np.ndarray, need: int) -> dict[int, int]:
        """For each first centroid met, how many of the second ones, the nearest first, are met together with it.

        A pair enters the heap once the pairs next to it on both nearer sides are out, so pairs leave it by rising summed distance; it goes
        on until cells of ``need`` entries in all (``held`` per pair) are out, or all.
        """
        near = distances(query[None, : self.half], self.first)[0]
        far = distances(query[None, self.half :], self.second)[0]
        rows, columns = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        held = held[np.ix_(rows, columns)].tolist()
        near, far, rows = near[rows].tolist(), far[columns].tolist(), rows.tolist()
        out = [0] * len(near)
        heap = [(near[0] + far[0], 0, 0)]
        met, wide = 0, len(far)
        while heap and met < need:
            _, i, j = heappop(heap)
            met += held[i][j]
            out[i] = j + 1
            if j + 1 < wide and (i == 0 or out[i - 1] > j + 1):
                heappush(heap, (near[i] + far[j + 1], i, j + 1))
            if i + 1 < len(near) and out[i + 1] == j:
                heappush(heap, (near[i + 1] + far[j], i + 1, j))
        return {rows[i]: n for i, n in enumerate(out) if n}


def fitted(sample: np.ndarray, entries: int, nearest: int, recall: float) -> MultiIndex:
    """An index for about ``entries`` vectors from a sample of unit vectors.

    There are about as many cells as a quarter of the entries. The share is the part of the sample that must be met, in order of summed
    distance, for the ``recall`` of the true ``nearest`` of sampled queries.
    """
    half = sample.shape[1] // 2
    number = min(MOST_CENTROIDS, 1 << max(0, round(np.log2(max(1.0, np.sqrt(entries) / 2)))), max(1, len(sample) // 4))
    index = MultiIndex(fitted_centroids(sample[:, :half], number), fitted_centroids(sample[:, half:], number), 1.0)
    a, b = index.cells(sample)
    needed = []
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        score = sample @ sample[i]
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(nearest, len(sample) - 1)]
        away = distances(sample[i : i + 1, :half], index.first)[0][a] + distances(sample[i : i + 1, half:], index.second)[0][b]
        needed.extend((np.searchsorted(np.sort(away), away[best], "right") / len(sample)).tolist())
    index.share = float(np.quantile(needed, recall)) if needed else 1.0
    return index


def nearest_neighbours(rows: DataFrame, nearest: int = 5, every: int = 50, recall: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by ``every`` the ``nearest`` others found, nearest first.

    ``rows`` has vec_id and embedding. Rows without an id, and vectors that are null, empty, zero or hold null or non-finite entries take no
    part, nor do vectors of another than the commonest length. Scores are cosines of the vectors as given; ties go to the
    smaller id. Rows that come again count once; of rows with one id and different vectors each is an entry and a query by
    itself, and none is a neighbour of its own id. Of equal vectors only the ``nearest`` + 1 smallest ids are entries, as
    no other can be among the nearest. An empty table gives an empty result; other columns are ignored.

    Entries lie in blocks by first centroid, cut into pieces of a bounded number of rows; a query goes once to each block that it
    meets. No cell, piece or search has a limit beyond the learnt share, and ``recall`` is what the share is learnt for.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    usable, wide = of_one_length(usable, "embedding")
    if not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = written(usable.dropDuplicates(["vec_id", "embedding"]), "vectors")
    kind = once.schema["embedding"].dataType.simpleString()
    hashed = F.xxhash64("embedding")
    different = once.select(F.approx_count_distinct(hashed)).first()[0]
    part = min(1.0, SAMPLE_ROWS / max(1, different))
    sampled = once.filter(F.abs(hashed / 2.0 ** 63) <= part).select("embedding").distinct().limit(2 * SAMPLE_ROWS).toArrow()
    if not sampled.num_rows:
        sampled = once.select("embedding").limit(SAMPLE_ROWS).toArrow()
    sample = unit(matrix(sampled.column("embedding"), wide))
    index = fitted(sample[np.lexsort(sample.T)], different, nearest, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = index.cells(unit(matrix(batch.column("embedding"), wide)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                                                 names=["vec_id", "embedding", "a", "b"])

    alike = Window.partitionBy("embedding").orderBy("vec_id")
    entries = once.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= nearest + 1).select("vec_id", "embedding")
    placed = written(entries.mapInArrow(place, f"vec_id long, embedding {kind}, a int, b int"), "cells")
    held = np.zeros((len(index.first), len(index.second)), np.int64)  # at most MOST_CENTROIDS squared numbers
    for r in placed.groupBy("a", "b").count().collect():
        held[r["a"], r["b"]] = r["count"]
    need = max(LEAST_ENTRIES, int(np.ceil(index.share * held.sum())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [index.reach(x, held, need) for x in unit(matrix(batch.column("query"), wide))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[{"a": a, "reach": n} for a, n in m.items()] for m in met], pa.list_(pa.struct([("a", pa.int32()), ("reach", pa.int32())])))],
                names=["query_id", "query", "met"])

    asked = once.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    asked = written(asked.mapInArrow(search, f"query_id long, query {kind}, met array<struct<a: int, reach: int>>"), "searches")
    asking = {r["a"]: r["count"] for r in asked.select(F.explode("met.a").alias("a")).groupBy("a").count().collect()}
    cut = [(a, max(1, -(-n // PIECE_ENTRIES)), max(1, -(-asking.get(a, 0) // PIECE_QUERIES))) for a, n in enumerate(held.sum(axis=1).tolist())]
    cut = F.broadcast(spark.createDataFrame(cut, "a int, pieces int, slices int"))  # a row per first centroid
    every_one = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    theirs = (asked.select("query_id", F.xxhash64("query").alias("mark"), "query", F.inline("met")).join(cut, "a")
              .withColumn("slice", F.pmod("mark", F.col("slices")).cast("int")).withColumn("piece", every_one("pieces")).drop("pieces", "slices"))
    ours = (placed.join(cut, "a").withColumn("piece", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("pieces")).cast("int"))
            .withColumn("slice", every_one("slices")).drop("pieces", "slices"))
    kinds = {"query_id": pa.int64(), "mark": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [tuple(np.empty(0, k.to_pandas_dtype()) for k in kinds.values())]
        if left.num_rows and right.num_rows:
            ids, own = (np.asarray(left.column(c)) for c in ("vec_id", "b"))
            given = matrix(left.column("embedding"), wide)
            units = unit(given)
            for at in range(0, right.num_rows, 256):
                some = right.slice(at, 256)
                asked_for, mark, reach = (np.asarray(some.column(c)) for c in ("query_id", "mark", "reach"))
                query = matrix(some.column("query"), wide)
                ready = unit(query)
                score = ready @ units.T
                score[(index.turns(ready)[:, own] >= reach[:, None]) | (ids[None] == asked_for[:, None])] = -np.inf
                # a product of matrices is rounded by its places: what comes close to the last rank is compared exactly
                rank = min(nearest, score.shape[1])
                last = np.partition(score, -rank, axis=1)[:, -rank] - 1e-9
                q, e = np.nonzero((score >= last[:, None]) & (score > -np.inf))
                exact = cosines(query[q], given[e])
                order = np.lexsort((ids[e], -exact, q))
                q, e, exact = q[order], e[order], exact[order]
                top = np.arange(len(q)) - np.searchsorted(q, q) < nearest
                out.append((asked_for[q[top]], mark[q[top]], ids[e[top]], exact[top]))
        return pa.table([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds.values())], names=list(kinds))

    group = ["a", "piece", "slice"]
    found = ours.groupBy(*group).cogroup(theirs.groupBy(*group)).applyInArrow(compare, "query_id long, mark long, vec_id long, score double")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
