"""Mutual information with a continuous target (D3; Kraskov, Stoegbauer,
Grassberger 2004, first estimator), exact on all rows, for all inputs in one
keyed job (kernel K2).

Both variables are scaled to unit population std and jittered as in D4. For each
point, eps_i is the distance to its k-th nearest neighbour in the joint space
under the max-norm; n_x(i) and n_y(i) count the other points strictly closer than
eps_i in x and in y; MI = psi(n) + psi(k) - mean(psi(n_x + 1) + psi(n_y + 1)), at
least 0.

  1. A bounded hash sample gives every input a k-d partition of its (x, y) plane:
     cells are halved at the median of their wider side until one holds about
     ``LEAF_ROWS`` rows, so sparse tails make large cells and crowded levels are
     cut along y, never into slices thinner than their jitter.
  2. A task holds one cell, orders its points in a small k-d tree of its own and
     finds each point's k nearest within the cell: an upper bound.
  3. Only points whose square of that bound leaves their cell are sent on, to the
     cells it meets, where the same tree finds what is nearer; those that meet one
     cell are dealt into blocks by their number.
  4. The counts are taken per axis: values in ranges of about ``LEAF_ROWS`` rows,
     each point's interval sent to the ranges of its two ends, binary search
     inside, and the ranges' totals for what lies between. The asks of a range
     are dealt into blocks by their number.

Without jitter the work is done on distinct (x, y) with their counts; at most
k + 1 copies matter to a k-th neighbour. Shuffled are the points once for 2, once
for 3 and their values for 4; the driver holds the sample, the cuts and a total
per range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import digamma, unit_noise
from quarry.operators.kernels import Cached
from quarry.operators.mi import RADIUS_GUARD

LEAF_ROWS = 20_000
MAX_LEAVES = 16_384             # cells per input; beyond, they grow
SAMPLE_PER_LEAF = 64
SAMPLE_VALUES = 4_000_000       # numbers the driver's sample holds at most (in expectation)
BUCKET = 24                     # points of a bucket of a task's tree
PAIRS = 400_000                 # (query, bucket) pairs compared at once


# ---- the partition of a plane --------------------------------------------------

class Partition:
    """A k-d tree over a sample: which cell a point lies in and which cells a
    square meets. A point on a cut belongs to the upper side."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.child, self.leaf = [], [], [], []
        self.n = 0
        self._grow(sample, max(1, math.ceil(len(sample) / max(1, leaves))))
        self.axis, self.cut = np.array(self.axis), np.array(self.cut, float)
        self.child, self.leaf = np.array(self.child).reshape(-1, 2), np.array(self.leaf)

    def _grow(self, p: np.ndarray, size: int) -> int:
        at = len(self.axis)
        self.axis.append(0), self.cut.append(0.0), self.child.append([at, at]), self.leaf.append(-1)
        wide = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
        v = p[:, wide]
        cut = float(np.sort(v)[len(v) // 2]) if len(p) > size else 0.0
        low = v < cut
        if len(p) <= size or not low.any():
            self.leaf[at] = self.n
            self.n += 1
            return at
        self.axis[at], self.cut[at] = wide, cut
        self.child[at] = [self._grow(p[low], size), self._grow(p[~low], size)]
        return at

    def locate(self, xy: np.ndarray) -> np.ndarray:
        node = np.zeros(len(xy), np.int64)
        open_ = np.flatnonzero(self.leaf[node] < 0)
        while len(open_):
            at = node[open_]
            right = xy[open_, self.axis[at]] >= self.cut[at]
            node[open_] = self.child[at, right.astype(int)]
            open_ = open_[self.leaf[node[open_]] < 0]
        return self.leaf[node]

    def met(self, xy: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) pairs of the cells within each point's radius."""
        q, node = np.arange(len(xy)), np.zeros(len(xy), np.int64)
        out_q, out_leaf = [], []
        while len(q):
            done = self.leaf[node] >= 0
            out_q.append(q[done])
            out_leaf.append(self.leaf[node[done]])
            q, node = q[~done], node[~done]
            off = xy[q, self.axis[node]] - self.cut[node]
            low, high = off <= radius[q], -off <= radius[q]
            q, node = (np.concatenate([q[low], q[high]]),
                       np.concatenate([self.child[node[low], 0], self.child[node[high], 1]]))
        return np.concatenate(out_q), np.concatenate(out_leaf)


# ---- neighbours inside one task --------------------------------------------------

class Buckets:
    """The points of one cell in a balanced tree whose leaves are buckets."""

    def __init__(self, xy: np.ndarray):
        m = len(xy)
        self.levels = max(0, math.ceil(math.log2(max(1, m / BUCKET))))
        order, node = np.arange(m), np.zeros(m, np.int64)
        self.boxes = []
        for level in range(self.levels + 1):
            starts = np.searchsorted(node, np.arange(1 << level))
            v = xy[order]
            lo, hi = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
            self.boxes.append((lo, hi))
            if level == self.levels:
                break
            wide = (hi - lo).argmax(1)
            within = np.lexsort((v[np.arange(m), wide[node]], node))
            order = order[within]
            size = np.diff(np.append(starts, m))
            place = np.arange(m) - starts[node]
            node = 2 * node + (place >= (size[node] + 1) // 2)
        self.order, self.starts = order, starts
        size = np.diff(np.append(starts, m))
        self.width = int(size.max())
        cols = starts[:, None] + np.arange(self.width)[None, :]
        self.members = np.where(np.arange(self.width)[None, :] < size[:, None], order[np.minimum(cols, m - 1)], -1)
        self.bucket_of = np.empty(m, np.int64)
        self.bucket_of[order] = node
        self.xy = xy

    def distances(self, q: np.ndarray, bucket: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Max-norm distances of queries to all points of a bucket each (inf where
        there is none, and for the query's own point)."""
        member = self.members[bucket]
        d = np.abs(self.xy[member] - q[:, None, :]).max(2)
        d[member < 0] = np.inf
        if own is not None:
            d[member == own[:, None]] = np.inf
        return d

    def nearest(self, q: np.ndarray, k: int, bound: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
        """The k least distances (inf where fewer) of each query, not beyond its
        ``bound``; ``own`` is the query's own point."""
        out = np.full((len(q), k), np.inf)
        step = max(1, PAIRS // 16)
        for lo in range(0, len(q), step):
            part = slice(lo, lo + step)
            out[part] = self._nearest(q[part], k, None if bound is None else bound[part], None if own is None else own[part])
        return out

    def _nearest(self, q, k, bound, own):
        best = np.full((len(q), k), np.inf)
        home = None
        if own is not None:
            home = self.bucket_of[own]
            d = np.sort(self.distances(q, home, own), axis=1)[:, :k]
            best[:, :d.shape[1]] = d
            bound = best[:, -1] if bound is None else np.minimum(bound, best[:, -1])
        i, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.levels + 1):
            lo, hi = self.boxes[level]
            away = np.maximum(np.maximum(lo[node] - q[i], q[i] - hi[node]), 0).max(1)
            near = away <= bound[i]
            i, node = i[near], node[near]
            if level < self.levels:
                i, node = np.repeat(i, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
        if home is not None:
            other = node != home[i]
            i, node = i[other], node[other]
        order = np.argsort(i, kind="stable")
        i, node = i[order], node[order]
        at = 0
        while at < len(i):
            # whole queries, about PAIRS / 16 pairs at a time
            stop = int(np.searchsorted(i, i[min(at + PAIRS // 16, len(i) - 1)], side="right"))
            r, b = i[at:stop], node[at:stop]
            d = self.distances(q[r], b, None if own is None else own[r])
            hit = d <= bound[r][:, None]
            rows = np.concatenate([np.repeat(r[:, None], d.shape[1], 1)[hit], np.repeat(np.unique(r), k)])
            dist = np.concatenate([d[hit], best[np.unique(r)].ravel()])
            by = np.lexsort((dist, rows))
            rows, dist = rows[by], dist[by]
            head = np.searchsorted(rows, np.unique(r))
            best[np.unique(r)] = dist[head[:, None] + np.arange(k)[None, :]]
            at = stop
        return best


# ---- on Spark ----------------------------------------------------------------------

def _text(values) -> pd.Series:
    """Strings as Python objects: a chunked string column cannot leave a task."""
    return pd.Series(np.array(values, dtype=object), dtype=object)


def _nothing(*columns) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _psi(x: np.ndarray) -> np.ndarray:
    """``functions.exprs.digamma`` in arrays."""
    z = x + 6.0
    z2 = z * z
    return (np.log(z) - 0.5 / z - (1 / 12) / z2 + (1 / 120) / z2**2 - (1 / 252) / z2**3 + (1 / 240) / z2**4
            - sum(1.0 / (x + i) for i in range(6)))


def _scaled(df: DataFrame, cols, key: str, seed, jitter: bool) -> dict:
    """Expressions of the scaled, jittered columns (``mi.scaled_jittered`` for all
    at once: two numbers a column come back)."""
    aggs = [e for i, c in enumerate(cols) for e in (F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"),
                                                   F.avg(F.abs(F.col(c).cast("double"))).alias(f"m{i}"))]
    st = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    out = {}
    for i, c in enumerate(cols):
        s = st[f"s{i}"] if st[f"s{i}"] and st[f"s{i}"] > 0 else 1.0
        out[c] = F.col(c).cast("double") / F.lit(s)
        if jitter:
            amp = 1e-10 * max(1.0, (st[f"m{i}"] or 0.0) / s)
            out[c] = out[c] + F.lit(amp) * unit_noise(seed, F.lit(c), key)
    return {"n": int(st["n"]), "columns": out}


def _leaf_count(spark, n: int, inputs: int) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    wanted = max(math.ceil(n / LEAF_ROWS), min(math.ceil(parts / inputs), n // 2000))
    return max(1, min(MAX_LEAVES, wanted, SAMPLE_VALUES // (16 * (inputs + 1))))


def _planes(points: DataFrame, inputs: int, n: int, leaves: int):
    """Per input its ``Partition`` and the cuts of both axes, from one hash sample."""
    wanted = min(leaves * SAMPLE_PER_LEAF, SAMPLE_VALUES // (inputs + 1))
    one_of = max(1, n // max(1, wanted))
    rows = points.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(one_of)) == 0).select("x", "y").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, inputs))
    y = rows["y"].to_numpy(float)
    planes, cuts = [], []
    for f in range(inputs):
        planes.append(Partition(np.stack([x[:, f], y], 1), leaves))
        for v in (x[:, f], y):
            ends = np.quantile(v, np.arange(1, leaves) / leaves, method="lower") if len(v) and leaves > 1 else []
            cuts.append(np.unique(ends))
    return planes, cuts


def _blocks(asks: DataFrame, places: int):
    """How many blocks the rows of each place ``g`` are dealt into, as a column function
    of ``g``. Asks may crowd where few points lie: those of a whole level go to a thin
    cell beside it, and intervals that end between two levels end in one range."""
    sizes = asks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).toPandas()     # one row per place
    blocks = np.ones(places, np.int64)
    blocks[sizes["g"]] = np.maximum(1, np.ceil(sizes["n"] / (4 * LEAF_ROWS)).astype(np.int64))
    shared = asks.sparkSession.sparkContext.broadcast(blocks)

    @F.pandas_udf("long")
    def n_blocks(g: pd.Series) -> pd.Series:
        return pd.Series(shared.value[g.to_numpy(np.int64)])

    return n_blocks


def _in_every_block(rows: DataFrame, n_blocks) -> DataFrame:
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("g") - 1)))


def _in_one_block(asks: DataFrame, n_blocks) -> DataFrame:
    return asks.withColumn("block", F.pmod(F.xxhash64("key"), n_blocks("g")))


def _radii(points: DataFrame, planes, k: int, keep) -> DataFrame:
    """(f, key, x, y, w, eps) of every point and input; ``key`` as text."""
    spark = points.sparkSession
    offset = np.cumsum([0] + [p.n for p in planes])
    shared = spark.sparkContext.broadcast((planes, offset))

    def place(batches):
        planes, offset = shared.value
        for b in batches:
            if not len(b):
                continue
            x, y = np.stack(b["x"].to_numpy()), b["y"].to_numpy(float)
            for f, plane in enumerate(planes):
                xy = np.stack([x[:, f], y], 1)
                yield pd.DataFrame({"g": offset[f] + plane.locate(xy), "f": np.int32(f), "key": _text(b["key"]),
                                    "x": xy[:, 0], "y": y, "w": b["w"].to_numpy(np.int64), "copy": b["copy"].to_numpy(np.int64)})

    cells = keep(points.mapInPandas(place, "g long, f int, key string, x double, y double, w long, copy long"))

    def inside(b: pd.DataFrame) -> pd.DataFrame:
        planes, offset = shared.value
        f, g = int(b["f"].iat[0]), int(b["g"].iat[0])
        xy = np.stack([b["x"].to_numpy(), b["y"].to_numpy()], 1)
        asks = np.flatnonzero(b["copy"].to_numpy() == 1)
        near = Buckets(xy).nearest(xy[asks], k, own=asks)
        out = pd.DataFrame({c: b[c].to_numpy()[asks] for c in ("f", "x", "y", "w")})
        out["key"] = _text(b["key"].to_numpy(object)[asks])
        out["near"] = pd.Series(list(near), dtype=object)
        q, leaf = planes[f].met(xy[asks], near[:, -1])
        q, leaf = q[leaf != g - offset[f]], leaf[leaf != g - offset[f]]
        order = np.argsort(q, kind="stable")
        far = np.split((offset[f] + leaf)[order], np.cumsum(np.bincount(q, minlength=len(asks)))[:-1])
        out["far"] = pd.Series(far, dtype=object)
        return out[["f", "key", "x", "y", "w", "near", "far"]]

    own = keep(cells.groupBy("g").applyInPandas(inside, "f int, key string, x double, y double, w long, near array<double>, far array<long>"))
    over = own.where(F.size("far") > 0)
    probes = over.select(F.explode("far").alias("g"), "f", "key", "x", "y", F.element_at("near", -1).alias("ub"))

    def beyond(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return _nothing("f", "key", "near")
        near = Buckets(np.stack([p["x"].to_numpy(), p["y"].to_numpy()], 1)).nearest(
            np.stack([q["x"].to_numpy(), q["y"].to_numpy()], 1), k, bound=q["ub"].to_numpy())
        found = np.isfinite(near[:, 0])
        return pd.DataFrame({"f": q["f"].to_numpy()[found], "key": _text(q["key"].to_numpy(object)[found]), "near": pd.Series(list(near[found]), dtype=object)})

    n_blocks = _blocks(over.select(F.explode("far").alias("g")), int(offset[-1]))
    more = _in_every_block(cells.select("g", "x", "y"), n_blocks).groupBy("g", "block").cogroup(
        _in_one_block(probes, n_blocks).groupBy("g", "block")).applyInPandas(beyond, "f int, key string, near array<double>")
    both = (over.select("f", "key", "x", "y", "w", "near").unionByName(more, allowMissingColumns=True)
            .groupBy("f", "key").agg(*[F.max(c).alias(c) for c in ("x", "y", "w")],
                                     F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), F.lit(k)).alias("eps")))
    return own.where(F.size("far") == 0).select("f", "key", "x", "y", "w", F.element_at("near", k).alias("eps")).unionByName(both)


def _psi_sums(rows: DataFrame, cuts, keep) -> dict:
    """Sum of w * psi(points strictly inside the radius, itself included), per axis
    (2 f for x, 2 f + 1 for y)."""
    spark = rows.sparkSession
    offset = np.cumsum([0] + [len(c) + 1 for c in cuts])
    shared = spark.sparkContext.broadcast((cuts, offset))

    def spread(batches):
        """Each point's interval [lo, hi] per axis with the ranges of both ends."""
        cuts, offset = shared.value
        for b in batches:
            for f in b["f"].unique():
                part = b[b["f"] == f]
                eps = part["eps"].to_numpy(float)
                for a, c in ((2 * f, "x"), (2 * f + 1, "y")):
                    v = part[c].to_numpy(float)
                    rg = np.maximum(eps * (1.0 - RADIUS_GUARD) - RADIUS_GUARD * np.abs(v), 0.0)
                    at = offset[a] + np.searchsorted(cuts[a], v, side="right")
                    lo, hi = v - rg, v + rg
                    yield pd.DataFrame({"a": np.int32(a), "g": at, "v": v, "key": _text(part["key"]), "w": part["w"].to_numpy(np.int64),
                                        "lo": lo, "hi": hi, "equal": eps <= 0,
                                        "glo": offset[a] + np.searchsorted(cuts[a], lo, side="right"),
                                        "ghi": offset[a] + np.searchsorted(cuts[a], hi, side="right")})

    t = keep(rows.mapInPandas(spread, "a int, g long, v double, key string, w long, lo double, hi double, equal boolean, glo long, ghi long"))
    sizes = t.groupBy("g").agg(F.sum("w").alias("w")).toPandas()    # one row per range
    total = np.zeros(offset[-1], np.int64)
    total[sizes["g"]] = sizes["w"]
    below = spark.sparkContext.broadcast(np.cumsum(total) - total)
    ends = F.when(F.col("glo") == F.col("ghi"), F.array("glo")).otherwise(F.array("glo", "ghi"))
    n_blocks = _blocks(t.select(F.explode(ends).alias("g")), int(offset[-1]))
    values = _in_every_block(t.groupBy("g", "v").agg(F.sum("w").alias("w")), n_blocks)
    asks = t.select("a", F.explode(ends).alias("g"), "key", "w", "lo", "hi", "equal", "glo", "ghi")
    asks = _in_one_block(asks, n_blocks)

    def count(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return _nothing("a", "key", "w", "c", "s")
        g = int(q["g"].iat[0])
        p = p.sort_values("v")
        v, sums = p["v"].to_numpy(float), np.append(0, np.cumsum(p["w"].to_numpy(np.int64))) + below.value[g]
        equal, lo, hi = q["equal"].to_numpy(bool), q["lo"].to_numpy(), q["hi"].to_numpy()
        # strictly inside (lo, hi); at radius 0 the values equal to it
        upper = sums[np.where(equal, np.searchsorted(v, hi, "right"), np.searchsorted(v, hi, "left"))]
        lower = sums[np.where(equal, np.searchsorted(v, lo, "left"), np.searchsorted(v, lo, "right"))]
        has_lo, has_hi = q["glo"].to_numpy() == g, q["ghi"].to_numpy() == g
        whole = has_lo & has_hi
        c = np.where(has_hi, upper, 0) - np.where(has_lo, lower, 0)
        w, a = q["w"].to_numpy(np.int64), q["a"].to_numpy(np.int32)
        # the whole ones as one sum, the ends of the others one by one
        rest = np.flatnonzero(~whole)
        total = (w[whole] * _psi(np.maximum(c[whole], 1).astype(float))).sum()
        return pd.DataFrame({"a": np.append(a[:1], a[rest]), "key": _text([None, *q["key"].to_numpy(object)[rest]]),
                             "w": np.append(0, w[rest]), "c": np.append(0, c[rest]), "s": np.append(total, np.zeros(len(rest)))})

    found = keep(values.groupBy("g", "block").cogroup(asks.groupBy("g", "block")).applyInPandas(count, "a int, key string, w long, c long, s double"))
    split = (found.where("key is not null").groupBy("a", "key").agg(F.max("w").alias("w"), F.sum("c").alias("c"))
             .select("a", (F.col("w") * digamma(F.greatest("c", F.lit(1)).cast("double"))).alias("s")))
    return {r["a"]: r["s"] for r in found.where("key is null").select("a", "s").union(split).groupBy("a").agg(F.sum("s").alias("s")).collect()}


def mi_regression(df: DataFrame, inputs, target: str, key: str | None, k: int = 3, seed=0, jitter: bool = True) -> dict:
    """D3: the score of every input, None with at most ``k`` rows. ``key`` identifies
    rows (its jitter); without jitter none is needed."""
    inputs = list(inputs)
    st = _scaled(df, [*inputs, target], key, seed, jitter)
    n, e = st["n"], st["columns"]
    if n <= k:
        return dict.fromkeys(inputs)
    with Cached() as keep:
        vectors = F.array(*[e[c] for c in inputs]).alias("x")
        if jitter:
            points = keep(df.select(F.col(key).cast("string").alias("key"), vectors, e[target].alias("y"),
                                    F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("copy")))
            return _scores(points, inputs, n, k, keep)
        # without jitter each input works on its distinct points
        out = {}
        for c in inputs:
            g = df.select(F.array(e[c]).alias("x"), e[target].alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
            g = g.select(F.concat_ws(":", F.col("x")[0].cast("string"), F.col("y").cast("string")).alias("key"), "x", "y", "w",
                         F.explode(F.sequence(F.lit(1).cast("long"), F.least("w", F.lit(k + 1).cast("long")))).alias("copy"))
            out |= _scores(keep(g), [c], n, k, keep)
        return out


def _scores(points: DataFrame, inputs, n: int, k: int, keep) -> dict:
    leaves = _leaf_count(points.sparkSession, n, len(inputs))
    planes, cuts = _planes(points, len(inputs), n, leaves)
    rows = keep(_radii(points, planes, k, keep))
    sums = _psi_sums(rows, cuts, keep)
    psi = lambda v: float(_psi(np.array([float(v)]))[0])
    return {c: max(0.0, psi(n) + psi(k) - (sums[2 * f] + sums[2 * f + 1]) / n) for f, c in enumerate(inputs)}


def mi_regression_feature(df: DataFrame, x: str, target: str, key: str, k: int = 3, seed=0, jitter: bool = True) -> DataFrame:
    """D3 for one input; returns one row (feature, score)."""
    score = mi_regression(df, [x], target, key, k, seed, jitter)[x]
    return df.sparkSession.createDataFrame([(x, score)], "feature string, score double")
