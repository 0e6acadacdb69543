"""Exact k-nearest-neighbour models (E9 regression, E15 classification),
kernel K4, on standardised inputs, in any number of dimensions.

Reference rows picked by hash are pivots, sqrt(n) of them or one per ``CELL_ROWS``
rows if that is more (``MAX_PIVOTS`` at most, so their broadcast is bounded), in two
levels: the first sqrt of them are top pivots, every pivot belongs to its nearest
top. A reference row goes to its nearest top and there to the nearest pivot: that
is its cell. Cells know their count and the least and greatest distance of their
rows to the pivot, tops the same of all their rows to the top. For a query:
  1. the cells next to it, in the nearest tops that together hold k rows, are
     searched; the k-th distance found is an upper bound ``ub``;
  2. by the triangle inequality a row x of a cell with pivot p can be within
     ``ub`` only if |d(q, p) - d(x, p)| <= ub, and, as x is no nearer to any other
     pivot of its top than to p, only if q lies within ``ub`` of p's side of the
     plane halfway to its own nearest pivot there. First tops are left out that way,
     then cells of the others, and inside the rest only rows that meet the first
     are compared. So a query meets the tops and the pivots near it, never all
     pivots, and a cell stays near ``CELL_ROWS`` rows at any number of rows.
All inputs take part in the pruning. A task holds one block of a cell's rows and
one block of the queries sent to it, compares them as arrays, and returns k rows
per query; cells and queries beyond ``BLOCK_ROWS`` are dealt into several
blocks, so a hot cell is never one task. Ties go to the smaller reference key.
Regression averages the k labels; classification takes the most frequent label
(ties to the lowest class), as the reference's estimators do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PIVOTS = 1 << 18
CELL_ROWS = 10_000
BLOCK_ROWS = 20_000
# Rounding of sums may not lose a row that lies exactly on the bound.
WIDEN = 1e-9
# The same for the difference of two squared distances, as a share of them.
SLACK = 1e-12


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, summed
    input by input."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


class Pivots:
    """Pivots in two levels, those of a top next to each other."""

    def __init__(self, rows: np.ndarray):
        self.tops = rows[:max(1, math.isqrt(len(rows)))]
        top = self._nearest(rows, self.tops)[0]
        order = np.argsort(top, kind="stable")
        self.pivots, self.top_of = rows[order], top[order]
        self.starts = np.searchsorted(self.top_of, np.arange(len(self.tops) + 1))

    @staticmethod
    def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, r = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = max(1, 4_000_000 // max(1, len(pivots)))
        for lo in range(0, len(x), step):
            d = _distances(x[lo:lo + step], pivots)
            at[lo:lo + step], r[lo:lo + step] = d.argmin(1), d.min(1)
        return at, r

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, its distance to the pivot and to the top."""
        top, r_top = self._nearest(x, self.tops)
        cell, r = np.zeros(len(x), np.int64), np.zeros(len(x))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            at, d = self._nearest(x[rows], self.pivots[self.starts[t]:self.starts[t + 1]])
            cell[rows], r[rows] = at + self.starts[t], d
        return cell, r, r_top


class Cells:
    """The pivots with each cell's row count and range of pivot distances, and the
    same of the tops. ``stats``: cell, n, low, high, top_low, top_high."""

    def __init__(self, pivots: Pivots, stats: pd.DataFrame):
        self.pivots = pivots
        m, t = len(pivots.pivots), len(pivots.tops)
        self.n, self.low, self.high = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf)
        at = stats["cell"].to_numpy(int)
        self.n[at], self.low[at], self.high[at] = stats["n"], stats["low"], stats["high"]
        self.top_n, self.top_low, self.top_high = np.zeros(t, np.int64), np.full(t, np.inf), np.full(t, -np.inf)
        np.add.at(self.top_n, pivots.top_of[at], stats["n"])
        np.minimum.at(self.top_low, pivots.top_of[at], stats["top_low"])
        np.maximum.at(self.top_high, pivots.top_of[at], stats["top_high"])
        self.tops_apart = _distances(pivots.tops, pivots.tops)

    def _cells_of(self, x, q, top):
        """(query, cell, distance) of all cells in (query, top) pairs."""
        size = np.diff(self.pivots.starts)[top]
        cell = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.pivots.starts[top], size)
        q = np.repeat(q, size)
        d = np.zeros(len(q))
        for j in range(x.shape[1]):
            d += (x[q, j] - self.pivots.pivots[cell, j]) ** 2
        return q, cell, np.sqrt(d)

    @staticmethod
    def _enough(q, d, n, k):
        """Which of each query's places, nearest first, are needed to hold k rows."""
        order = np.lexsort((d, q))
        counts = n[order]
        before = np.cumsum(counts) - counts
        head = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(q) else []
        before = before - np.repeat(before[head], np.diff(np.append(head, len(q))))
        take = np.zeros(len(q), bool)
        take[order] = before < k
        return take & (n > 0)

    def first(self, x: np.ndarray, k: int):
        """(query, cell, distance) of the nearest cells that hold k rows together."""
        d = _distances(x, self.pivots.tops)
        q, top = np.divmod(np.arange(d.size), d.shape[1])
        take = self._enough(q, d.ravel(), self.top_n[top], k)
        q, cell, d = self._cells_of(x, q[take], top[take])
        take = self._enough(q, d, self.n[cell], k)
        return q[take], cell[take], d[take]

    @staticmethod
    def _reached(d, least, apart, edge):
        """Whether a query at distance ``d`` from a place and ``least`` from its nearest
        one, ``apart`` from the other, is within ``edge`` of the former's side."""
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (d ** 2 - least ** 2 - SLACK * (d ** 2 + least ** 2)) / (2 * apart)
        return ~((apart > 0) & (off > edge))

    def within(self, x: np.ndarray, ub: np.ndarray):
        """(query, cell, distance) of the cells that can hold a row within ``ub``."""
        edge = ub * (1 + WIDEN) + WIDEN
        d = _distances(x, self.pivots.tops)
        near = (d - self.top_high <= edge[:, None]) & (self.top_low - d <= edge[:, None]) & (self.top_n > 0)
        near &= self._reached(d, d.min(1)[:, None], self.tops_apart[d.argmin(1)], edge[:, None])
        q, top = np.nonzero(near)
        size = np.diff(self.pivots.starts)[top]         # a top is a pivot of its own: 1 at least
        q, cell, d = self._cells_of(x, q, top)
        if not len(q):
            return q, cell, d
        place = np.repeat(np.arange(len(size)), size)
        least = np.minimum.reduceat(d, np.cumsum(size) - size)[place]
        at = np.flatnonzero(d == least)
        home = np.zeros(len(size), np.int64)
        home[place[at]] = cell[at]
        apart = np.zeros(len(q))
        for j in range(x.shape[1]):
            apart += (self.pivots.pivots[cell, j] - self.pivots.pivots[home[place], j]) ** 2
        near = (d - self.high[cell] <= edge[q]) & (self.low[cell] - d <= edge[q]) & (self.n[cell] > 0)
        near &= self._reached(d, least, np.sqrt(apart), edge[q])
        return q[near], cell[near], d[near]


def assign(df: DataFrame, pivots: Pivots, others: str) -> DataFrame:
    """``df`` (with ``v``), its ``cell`` and its distances to pivot (``r``) and top."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, r double, r_top double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, shared.value.tops.shape[1]))
        cell, r, r_top = shared.value.assign(x)
        return pd.DataFrame({"cell": cell, "r": r, "r_top": r_top})

    return df.withColumn("__a", nearest("v")).select(*others.split(), "v", "__a.cell", "__a.r", "__a.r_top")


def _k_nearest(x: np.ndarray, rid: np.ndarray, q: np.ndarray, k: int):
    """(query, row, distance) of the k nearest rows of each query, ties to the smaller
    ``rid``. Only the rows up to the k-th distance are put in order."""
    step = max(1, PAIRS // len(x))
    for lo in range(0, len(q), step):
        d = _distances(q[lo:lo + step], x)
        edge = np.full(len(d), np.inf) if len(x) <= k else np.fmin(np.partition(d, k - 1, axis=1)[:, k - 1], np.inf)
        i, j = np.nonzero(d <= edge[:, None])
        d = d[i, j]
        order = np.lexsort((rid[j], d, i))
        i, j, d = i[order], j[order], d[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[best] + lo, j[best], d[best]


PAIRS = 500_000         # (query, row) pairs of a cell that are compared at once
QUERY_STEP = 1024       # queries that are compared with the pivots at once


def _probes(qry: DataFrame, shared, k: int, second: bool) -> DataFrame:
    """(qid, v, d, ub, cell): the cells that each query searches first, or (with
    its ``ub``) those it still has to search."""
    def run(batches):
        cells = shared.value
        for b in batches:
            for lo in range(0, len(b), QUERY_STEP):
                part = b.iloc[lo:lo + QUERY_STEP]
                x = np.stack(part["v"].to_numpy())
                i, c, d = cells.first(x, k)
                ub = np.full(len(part), np.inf)
                if second:
                    ub = part["ub"].to_numpy(float)
                    done = i * len(cells.n) + c
                    i, c, d = cells.within(x, ub)
                    rest = ~np.isin(i * len(cells.n) + c, done)
                    i, c, d = i[rest], c[rest], d[rest]
                yield pd.DataFrame({"qid": part["qid"].to_numpy(object)[i], "v": part["v"].to_numpy(object)[i],
                                    "d": d, "ub": ub[i], "cell": c.astype(np.int32)})

    kind = qry.schema["qid"].dataType.simpleString()
    return qry.mapInPandas(run, f"qid {kind}, v array<double>, d double, ub double, cell int")


def _search(cells: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(qid, dist, rid, label): per query and block of rows the k nearest."""
    def parts(df, key):
        """Blocks per cell, from its count."""
        sizes = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(f"n_{key}"))
        return sizes

    sizes = parts(cells, "x").join(parts(probes, "q"), "cell")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = (cells.join(sizes, "cell").withColumn("px", F.pmod(F.xxhash64("rid"), F.col("n_x")).cast("int"))
            .select("cell", "rid", "label", "v", "r", "px", every("n_q", "pq")))
    right = (probes.join(sizes, "cell").withColumn("pq", F.pmod(F.xxhash64("qid"), F.col("n_q")).cast("int"))
             .select("cell", "qid", F.col("v").alias("qv"), "d", "ub", "pq", every("n_x", "px")))
    kinds = {"qid": probes.schema["qid"].dataType.simpleString(), "rid": cells.schema["rid"].dataType.simpleString()}

    def nearest(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(q):
            x = x.sort_values(["r", "rid"])
            xv, r = np.stack(x["v"].to_numpy()), x["r"].to_numpy()
            rid, label, qid = x["rid"].to_numpy(), x["label"].to_numpy(), q["qid"].to_numpy()
            qv, d, ub = np.stack(q["qv"].to_numpy()), q["d"].to_numpy(), q["ub"].to_numpy()
            edge = ub * (1 + WIDEN) + WIDEN
            lo, hi = np.searchsorted(r, d - edge, "left"), np.searchsorted(r, d + edge, "right")
            free = np.flatnonzero(np.isinf(ub))         # without a bound: all rows are compared
            for i, j, dist in _k_nearest(xv, rid, qv[free], k):
                found.append((qid[free[i]], dist, rid[j], label[j]))
            for i in np.flatnonzero((hi > lo) & ~np.isinf(ub)):
                dist = _distances(qv[i:i + 1], xv[lo[i]:hi[i]])[0]
                near = np.flatnonzero(dist <= edge[i])
                if len(near) > k:       # only those up to the k-th distance are ordered
                    near = near[dist[near] <= np.partition(dist[near], k - 1)[k - 1]]
                best = near[np.lexsort((rid[lo[i] + near], dist[near]))[:k]]
                found.append((np.repeat(qid[i], len(best)), dist[best], rid[lo[i] + best], label[lo[i] + best]))
        if not found:
            return pd.DataFrame({"qid": [], "dist": [], "rid": [], "label": []})
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(["qid", "dist", "rid", "label"], zip(*found), strict=True)})

    return left.groupBy("cell", "px", "pq").cogroup(right.groupBy("cell", "px", "pq")).applyInPandas(
        nearest, f"qid {kinds['qid']}, dist double, rid {kinds['rid']}, label double")


def _k_best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)


def knn_cells(ref: DataFrame) -> tuple[DataFrame, Cells]:
    """The reference rows with their cells, and the cells' facts."""
    n = ref.count()
    wanted = max(1, min(MAX_PIVOTS, max(math.isqrt(n), n // CELL_ROWS)))
    rows = ref.select("v").orderBy(F.md5(F.col("rid").cast("string"))).limit(wanted).collect()
    if not rows:
        raise ValueError("no reference rows")
    found = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)
    # each value once, in the order of their hashes: the tops are a sample too
    pivots = Pivots(found[np.sort(np.unique(found, axis=0, return_index=True)[1])])
    cells = assign(ref, pivots, "rid label").persist()
    stats = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"),
                                      F.min("r_top").alias("top_low"), F.max("r_top").alias("top_high")).toPandas()
    return cells, Cells(pivots, stats)


def knn_neighbours(ref: DataFrame, qry: DataFrame, d: int, k: int, cells=None) -> DataFrame:
    """(qid, rid, dist, label) for the k nearest reference rows of every
    query row. ``ref`` has (rid, label, v), ``qry`` has (qid, v); a query with a
    missing input finds nothing."""
    table, facts = cells or knn_cells(ref)
    shared = ref.sparkSession.sparkContext.broadcast(facts)
    qry = qry.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("qid", "v").persist()
    first = _k_best(_search(table, _probes(qry, shared, k, False), k), k).persist()      # read for the bound and for the result
    ub = first.groupBy("qid").agg(F.max("dist").alias("ub"), F.count(F.lit(1)).alias("m"))
    # fewer than k reference rows: everything was searched
    q = qry.join(ub.where(F.col("m") >= k).select("qid", "ub"), "qid")
    rest = _search(table, _probes(q, shared, k, True), k)
    return _k_best(first.drop("__r").unionByName(rest), k).drop("__r")


class KnnModel:
    """Encoder + standardiser pipeline and the standardised training rows."""

    def __init__(self, features: PipelineModel, reference: DataFrame, k: int, task: str, d: int):
        self.features, self.reference, self.k, self.task, self.d = features, reference, k, task, d
        self.cells = None

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, prediction): mean label (regression) or majority label with
        ties to the lowest class index (classification)."""
        q = self.features.transform(df).select(F.col(key).alias("qid"), vector_to_array("features").alias("v"))
        if self.cells is None:
            self.cells = knn_cells(self.reference)
        nb = knn_neighbours(self.reference, q, self.d, self.k, self.cells)
        if self.task == "regression":
            out = nb.groupBy("qid").agg(F.avg("label").alias("prediction"))
        else:
            votes = nb.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("v"))
            w = Window.partitionBy("qid").orderBy(F.desc("v"), "label")
            out = votes.withColumn("r", F.row_number().over(w)).where("r = 1") \
                .select("qid", F.col("label").alias("prediction"))
        return out.withColumnRenamed("qid", key)

    def release(self) -> None:
        """Free the cached rows of the cells."""
        if self.cells is not None:
            self.cells[0].unpersist()
            self.cells = None


def fit_knn(data: DataFrame, inputs, task: str, k: int, key: str) -> KnnModel:
    """``data`` has the inputs and a DOUBLE ``label`` (class index for
    classification) and a unique ``key``."""
    from pyspark.ml.feature import StandardScaler

    from quarry.operators.prep import encoder_stages
    enc, _ = encoder_stages(data, inputs, scale=False, out="__raw")
    stages = list(enc) + [StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)]
    pm = Pipeline(stages=stages).fit(data)
    t = pm.transform(data).select(F.col(key).alias("rid"), F.col("label").cast("double").alias("label"),
                                  vector_to_array("features").alias("v"))
    return KnnModel(pm, t, k, task, int(len(pm.stages[-1].mean)))
