"""Approximate nearest neighbours by collision counting.

Vectors are normalised and projected on ``PROJECTIONS`` random directions.  For each direction the
projected values are one sorted array.  A query looks at the entries inside a window centred at
its own projection; virtual rehashing widens all its windows step by step, and only the entries
that a step adds are counted.  A vector that collides with the query in at least ``THRESHOLD`` of
the directions is verified: its cosine is computed on the original vectors in double precision.
A query widens until it has verified ``k`` plus a share ``VERIFIED`` of the block (``LEAST_VERIFIED`` vectors
at least), or everything.

Every row is indexed.  Vectors are dealt into blocks of about ``BLOCK_ROWS`` rows by a hash of
their id and queries into chunks of ``CHUNK_ROWS``; each (block, chunk) is one bounded task, whose
k best meet those of the other blocks.  No index is sampled and no bucket is capped.

Rules: rows whose id is null, or whose vector is null, empty, zero, or holds a null or non-finite
component, take no part, and nor do vectors with another number of components than most rows have.
Ties go to the smaller vec_id.  Rows that repeat an id and a vector are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, VERIFIED = 256, 0.45, 0.06
#: Vectors that a query verifies in a block at least: a share of a small block would be too few to hold the nearest.
LEAST_VERIFIED = 1000
FIRST_WIDTH, WIDER = 0.55, 1.1
BLOCK_ROWS, CHUNK_ROWS = 16384, 1024


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 7):
        self.vectors = vectors
        self.scale = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = (vectors / self.scale[:, None]) @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int64).copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, cosines) of everything verified; ``own`` has the rows to leave out for each query.

        All queries of a step share the look-up of their windows in each sorted array.
        """
        n, projections = len(self.vectors), len(self.order)
        size = np.sqrt((queries * queries).sum(axis=1))
        centres = ((queries / size[:, None]) @ self.directions).T
        share = max(int(np.ceil(VERIFIED * n)), LEAST_VERIFIED)
        base = np.minimum(n, k + np.array([len(o) for o in own]) + share)
        counts = np.zeros((len(queries), n), np.int16)
        width, least = FIRST_WIDTH, int(np.ceil(THRESHOLD * projections))
        active, before = np.arange(len(queries)), None
        while len(active):
            low = np.array([np.searchsorted(row, c - width) for row, c in zip(self.sorted, centres[:, active], strict=True)]).T
            high = np.array([np.searchsorted(row, c + width) for row, c in zip(self.sorted, centres[:, active], strict=True)]).T
            wider = []
            for i, q in enumerate(active.tolist()):
                lo, hi = low[i].tolist(), high[i].tolist()
                if before is None:
                    rings = [row[a:b] for row, a, b in zip(self.order, lo, hi, strict=True)]
                else:
                    inner, outer = before[0][i].tolist(), before[1][i].tolist()
                    rings = [row[a:b] for row, a, b in zip(self.order, lo, inner, strict=True)]
                    rings += [row[a:b] for row, a, b in zip(self.order, outer, hi, strict=True)]
                counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int16)
                found = np.flatnonzero(counts[q] >= least)
                if len(found) < base[q]:
                    wider.append(i)
                    continue
                found = np.setdiff1d(found, own[q], assume_unique=True)
                # a sum per row, not a matrix product: equal vectors get equal scores
                dots = (self.vectors[found] * queries[q]).sum(axis=1)
                yield q, found, dots / (self.scale[found] * size[q])
            active, before = active[wider], (low[wider], high[wider])
            width *= WIDER


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    double = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), double.alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == usual[0]["n"]).distinct() if usual else rows


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row whose id ``every`` divides."""
    rows = usable(vectors)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    chunks = max(1, -(-queries.count() // CHUNK_ROWS))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("*", deal(blocks, 1).alias("block")).select("*", every_one(chunks).alias("chunk"))
    asked = queries.select("*", deal(chunks, 2).alias("chunk")).select("*", every_one(blocks).alias("block"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        flat = table.column("embedding").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else flat.values
        return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            ids, all_vectors = matrix(left)
            index = CollisionIndex(all_vectors)
            asked_ids, asked_vectors = matrix(right)
            own = [np.flatnonzero(ids == i) for i in asked_ids]
            for query, found, scores in index.search(asked_vectors, k, own):
                best = _best(ids[found], scores, k)
                out[0] += [asked_ids[query]] * len(best)
                out[1] += ids[found][best].tolist()
                out[2] += scores[best].tolist()
        kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds, out, strict=True)})

    key = ["block", "chunk"]
    found = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    # k rows from each block for each query
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
