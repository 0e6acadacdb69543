"""Distance correlation (D5; Szekely, Rizzo, Bakirov 2007), V-statistic,
on all rows and without forming pairs (kernel K3).

With a_i = sum_j |x_i - x_j|, b_i = sum_j |y_i - y_j| and
A = sum_ij |x_i - x_j| |y_i - y_j|:

  dCov^2 = A / n^2 - 2 sum_i a_i b_i / n^3 + (sum a)(sum b) / n^4
  dVar^2(x) = sum_ij (x_i - x_j)^2 / n^2 - 2 sum_i a_i^2 / n^3 + (sum a)^2 / n^4
  dCor = sqrt(dCov^2 / sqrt(dVar^2(x) dVar^2(y)))

Row sums are prefix sums over the sorted values (K1). The pair sum A comes
from a dyadic decomposition of the (x, y) order: every pair p < q of
positions meets in exactly one (level, block) with p in the left half and q
in the right; there, running sums of 1, x, y, xy over the left half, in y
order, give each right row's share: n log n steps and no pair. Rows are shuffled
once by block of ``INNER_ROWS`` positions, whose task sums every level inside;
only the few levels above write a row per level, split by y buckets (K1). Rows are pre-aggregated into
distinct (x, y) with a count, so repeated values cost nothing, and x and y
are centred first so the sums do not cancel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.kernels import (bucket_count, bucketize, cut_points, ordered_positions,
                                      prefix_below, rows_per_bucket)


def _row_sums(pairs: DataFrame, v: str, n: int, cuts) -> DataFrame:
    """(v, s) with s = sum_j |v - v_j| over all rows, from K1 prefix sums."""
    spark = pairs.sparkSession
    vals = pairs.groupBy(F.col(v).alias("v")).agg(F.sum("c").alias("c"))
    vals = vals.withColumn("cv", F.col("c") * F.col("v"))
    b = bucketize(vals, "v", cuts, "__vb")
    r = prefix_below(b, [], "__vb", ["v"], ["c", "cv"], out=["lc", "lsum"], rows_bound=len(cuts) + 1)
    tot = pairs.agg(F.sum(F.col("c") * F.col(v)).alias("t")).first()["t"] or 0.0
    gc = F.lit(float(n)) - F.col("lc") - F.col("c")
    gs = F.lit(float(tot)) - F.col("lsum") - F.col("cv")
    s = F.col("v") * F.col("lc") - F.col("lsum") + gs - F.col("v") * gc
    return r.select("v", s.alias("s"))


# Rows of one block of positions; the levels below it are summed in one task.
INNER_ROWS = 1 << 17


def _inner_sum(pos: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray, levels: int) -> float:
    """Sum over position pairs p < q that share a block of 2^levels positions of
    c_p c_q (x_q - x_p) |y_q - y_p|: at each level the left half of every block
    meets its right half, by running sums in y order."""
    total = 0.0
    w_all = np.stack([c, c * y, c * x, c * x * y])
    for lvl in range(levels):
        blk, side = pos >> (lvl + 1), (pos >> lvl) & 1
        o = np.lexsort((pos, side, y, blk))
        new = np.r_[True, blk[o][1:] != blk[o][:-1]]
        at, start = np.cumsum(new) - 1, np.flatnonzero(new)
        right = side[o] == 1
        w = np.where(right, 0.0, w_all[:, o])
        run = np.cumsum(w, axis=1)
        base = np.concatenate([np.zeros((4, 1)), run[:, start[1:] - 1]], axis=1)
        below = run - w - base[:, at]
        above = (run[:, np.r_[start[1:] - 1, len(o) - 1]] - base)[:, at] - below
        xo, yo = x[o], y[o]
        pair = lambda v: xo * yo * v[0] - xo * v[1] - yo * v[2] + v[3]
        total += float((c[o] * (pair(below) - pair(above)))[right].sum())
    return total


def pair_sum(pairs: DataFrame, m: int) -> float:
    """A / 2 = sum over position pairs p < q of c_p c_q (x_q - x_p) |y_q - y_p|.

    Rows are shuffled once by block of positions; a task sums all levels inside
    its block. Only the few levels above write a row per level."""
    spark = pairs.sparkSession
    levels = max(1, math.ceil(math.log2(max(m, 2))))
    pos = ordered_positions(pairs, ["x", "y"], n_rows=m)
    limit = max(2, min(INNER_ROWS, rows_per_bucket(spark)))
    inner = max(0, min(levels, int(math.floor(math.log2(limit)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        a = _inner_sum(*(pdf[k].to_numpy() for k in ("pos", "x", "y", "c")), inner)
        return pd.DataFrame({"a": [a]})

    if inner < levels:
        pos = pos.persist()
    total = (pos.select("pos", "x", "y", "c", F.expr(f"shiftright(pos, {inner})").alias("blk"))
             .groupBy("blk").applyInPandas(run, "a double").agg(F.sum("a")).first()[0] or 0.0)
    if inner >= levels:
        return total
    ex = pos.select("x", "y", "c", "pos", F.explode(F.sequence(F.lit(inner), F.lit(levels - 1))).alias("lvl"))
    ex = ex.withColumn("blk", F.expr("shiftright(pos, lvl + 1)")) \
           .withColumn("side", F.expr("cast(shiftright(pos, lvl) & 1 as int)"))
    left = F.col("side") == 0
    ws = [F.when(left, F.col("c")).otherwise(0.0), F.when(left, F.col("c") * F.col("y")).otherwise(0.0),
          F.when(left, F.col("c") * F.col("x")).otherwise(0.0),
          F.when(left, F.col("c") * F.col("x") * F.col("y")).otherwise(0.0)]
    ex = ex.select("*", *[w.alias(f"w{i}") for i, w in enumerate(ws)])
    cuts = cut_points(pairs, ["y"], bucket_count(spark, m))["y"]
    big = bucketize(ex, "y", cuts, "__yb")
    nblocks = sum(max(1, m >> (lv + 1)) for lv in range(inner, levels))
    big = prefix_below(big, ["lvl", "blk"], "__yb", ["y", "side", "pos"], [f"w{i}" for i in range(4)],
                       out=[f"l{i}" for i in range(4)], rows_bound=nblocks * (len(cuts) + 1))
    allr = _block_totals(big.drop("__yb"))
    x, y = F.col("x"), F.col("y")
    first = x * y * F.col("l0") - x * F.col("l1") - y * F.col("l2") + F.col("l3")
    g = [F.col(f"t{i}") - F.col(f"l{i}") for i in range(4)]
    second = -(x * y * g[0] - x * g[1] - y * g[2] + g[3])
    contrib = F.when(F.col("side") == 1, F.col("c") * (first + second)).otherwise(0.0)
    top = allr.agg(F.sum(contrib).alias("a")).first()["a"] or 0.0
    pos.unpersist()
    return total + top


def _block_totals(allr: DataFrame) -> DataFrame:
    """Left-half totals per (level, block) by a grouped aggregate joined
    back (AQE broadcasts it when small), so no window spans a big block."""
    t = allr.groupBy("lvl", "blk").agg(*[F.sum(f"w{i}").alias(f"t{i}") for i in range(4)])
    return allr.join(t, ["lvl", "blk"])


def dcor_pair(df: DataFrame, x: str, y: str) -> float | None:
    """Distance correlation of two columns over the rows where both are
    present; None for fewer than 2 rows."""
    spark = df.sparkSession
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    st = d.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
               F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).first()
    n = int(st["n"])
    if n < 2:
        return None
    if not st["vx"] or not st["vy"]:
        return 0.0
    c = d.select((F.col("x") - F.lit(st["mx"])).alias("x"), (F.col("y") - F.lit(st["my"])).alias("y"))
    pairs = c.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("c")).persist()
    m = pairs.count()
    nb = bucket_count(spark, m)
    cuts = cut_points(pairs, ["x", "y"], nb)
    ax = _row_sums(pairs, "x", n, cuts["x"])
    by = _row_sums(pairs, "y", n, cuts["y"])
    j = pairs.join(ax.withColumnRenamed("v", "x").withColumnRenamed("s", "a"), "x") \
             .join(by.withColumnRenamed("v", "y").withColumnRenamed("s", "b"), "y")
    agg = j.agg(F.sum(F.col("c") * F.col("a")).alias("sa"), F.sum(F.col("c") * F.col("b")).alias("sb"),
                F.sum(F.col("c") * F.col("a") * F.col("b")).alias("sab"),
                F.sum(F.col("c") * F.col("a") * F.col("a")).alias("saa"),
                F.sum(F.col("c") * F.col("b") * F.col("b")).alias("sbb"),
                F.sum(F.col("c") * F.col("x") * F.col("x")).alias("sxx"),
                F.sum(F.col("c") * F.col("y") * F.col("y")).alias("syy"),
                F.sum(F.col("c") * F.col("x")).alias("sx"), F.sum(F.col("c") * F.col("y")).alias("sy")).first()
    a_half = pair_sum(pairs, m)
    pairs.unpersist()
    nn = float(n)
    A = 2.0 * a_half
    dcov2 = A / nn ** 2 - 2.0 * agg["sab"] / nn ** 3 + agg["sa"] * agg["sb"] / nn ** 4
    sq_x = 2.0 * nn * agg["sxx"] - 2.0 * agg["sx"] ** 2
    sq_y = 2.0 * nn * agg["syy"] - 2.0 * agg["sy"] ** 2
    dvx = sq_x / nn ** 2 - 2.0 * agg["saa"] / nn ** 3 + agg["sa"] ** 2 / nn ** 4
    dvy = sq_y / nn ** 2 - 2.0 * agg["sbb"] / nn ** 3 + agg["sb"] ** 2 / nn ** 4
    den = math.sqrt(dvx * dvy) if dvx > 0 and dvy > 0 else 0.0
    if den <= 0:
        return 0.0
    return math.sqrt(max(dcov2 / den, 0.0))


def distance_correlation(prep, sample: int | None = None, seed=0, key: str | None = None) -> DataFrame:
    """D5 for every used input of a prepared frame: one row per input.
    ``sample`` keeps the reference's optional cap (an exact-size md5 sample,
    B15); by default every row is used."""
    spark = prep.frame.sparkSession
    frame = prep.frame
    if sample:
        from quarry.operators.prep import sample_rows
        k = key or prep.extra.get("key")
        if k is None:
            raise ValueError("a sample needs a key column")
        frame = sample_rows(frame, sample, seed, k)
    from quarry.session import run_parallel
    rows = run_parallel([lambda f=f: (f, dcor_pair(frame, f, prep.target)) for f in prep.used])
    return spark.createDataFrame(rows, "feature string, score double")
