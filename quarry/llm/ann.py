"""Operator 3: nearest neighbours by collision counting on single projections.

The rows are dealt into blocks of about ``BLOCK_ROWS``. A block keeps, for each of
``PROJECTIONS`` random directions, its vectors' projections as one sorted array.
A query opens a window around its own projection in every array; virtual
rehashing widens all windows together (half width ``WIDTH / 2 * radius``, the
radius growing by ``GROWTH``), and only what a window gains is counted. A vector
that lies in ``share_needed`` of the windows is verified by its exact distance.
The search of a block ends when its k-th verified distance is within the radius:
a vector at that radius collides in each window with probability 2 Phi(WIDTH/2) - 1,
and the threshold lies two standard deviations below, so about 98 in 100 such
vectors (and more of the nearer ones) have been verified by then. With all
windows full the search is exact, so small blocks and far queries lose nothing.

Queries travel in blocks of ``QUERY_BLOCK`` to every block of rows; each pair of
blocks is one bounded task group, whose k best per query are merged by a
window that keeps k rows per task before its shuffle.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without vec_id; rows repeating a vec_id
count once (the smallest vector); vectors of another length than the query's
are no candidates; with fewer than k candidates all are returned; ties go to the
smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64
WIDTH = 0.8
GROWTH = 1.25
FIRST_RADIUS = 0.6          # of a block's spread
BLOCK_ROWS = 16_384
QUERY_BLOCK = 2_048
SEED = 11


def share_needed(projections: int = PROJECTIONS, width: float = WIDTH) -> int:
    """Collision threshold: two standard deviations below the mean count of a
    vector at the radius."""
    from math import erf, floor, sqrt
    p = erf(width / 2 / sqrt(2))
    return max(1, floor(projections * p - 2 * sqrt(projections * p * (1 - p))))


class SortedProjections:
    """The sorted arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = vectors[order].astype(np.float64), ids[order]
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        p = self.x @ self.directions
        self.rows = np.argsort(p, axis=0, kind="stable").T.astype(np.int32).copy()
        self.values = np.take_along_axis(p, self.rows.T.astype(np.int64), axis=0).T.copy()

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, start: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and distances of its k nearest verified vectors."""
        return [self._one(q, o, k, start) for q, o in zip(queries.astype(np.float64), own, strict=True)]

    def _one(self, q, own, k, radius):
        m, n = self.rows.shape
        need = share_needed(m)
        centre = q @ self.directions
        low = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre, strict=True)])
        high = low.copy()
        count = np.zeros(n, np.int16)
        verified = self.ids == own          # the query's own row is no candidate
        ids, dist = np.zeros(0, self.ids.dtype), np.zeros(0)
        while True:
            half = WIDTH / 2 * radius
            for i in range(m):
                v, r = self.values[i], self.rows[i]
                a, b = np.searchsorted(v, (centre[i] - half, centre[i] + half))
                if a < low[i]:
                    count[r[a:low[i]]] += 1
                    low[i] = a
                if b > high[i]:
                    count[r[high[i]:b]] += 1
                    high[i] = b
            new = np.flatnonzero((count >= need) & ~verified)
            if len(new):
                verified[new] = True
                ids = np.append(ids, self.ids[new])
                dist = np.append(dist, np.sqrt(((self.x[new] - q) ** 2).sum(1)))
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            if len(ids) == k and dist[-1] <= radius or verified.all():
                return ids, dist
            radius *= GROWTH


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v of the vectors that take part."""
    v = F.col(vector_col)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad).where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row for which
    ``is_query`` (a condition on vec_id) holds."""
    use = usable(rows)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    groups = max(1, -(-rows.where(is_query).count() // QUERY_BLOCK))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    data = use.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    queries = data.where(is_query).drop("block").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))

    def search(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(d) or not len(q):
            return out
        index = SortedProjections(np.stack(d["v"].to_numpy()), d["vec_id"].to_numpy())
        vectors, own = np.stack(q["v"].to_numpy()), q["vec_id"].to_numpy()
        # first radius: below the distances that are usual in this block
        start = max(float(np.sqrt(index.x.var(axis=0).sum())) * FIRST_RADIUS, 1e-12)
        found = index.search(vectors, own, k, start)
        return pd.DataFrame({"query_id": np.repeat(own, [len(i) for i, _ in found]),
                             "vec_id": np.concatenate([i for i, _ in found]),
                             "score": np.concatenate([s for _, s in found])}) if found else out

    left = data.select("vec_id", "v", "dim", "block", every(groups, "part")).groupBy("dim", "block", "part")
    right = queries.select("vec_id", "v", "dim", "part", every(blocks, "block")).groupBy("dim", "block", "part")
    best = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
