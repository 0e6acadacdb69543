"""Mutual information with a class target (D4; Ross 2014) and with a
continuous target (D3; Kraskov, Stoegbauer, Grassberger 2004).

D4, per input x (scaled to unit population std, plus a deterministic
jitter of 1e-10 * max(1, mean|x|) as the reference's library adds noise):

  * within each class c with n_c > 1 points, r_i is the distance to the
    k_c-th nearest neighbour, k_c = min(k, n_c - 1);
  * m_i is the number of points (of all classes with n_c > 1) strictly
    closer to x_i than r_i, the point itself included;
  * MI = psi(n) + mean psi(k_c) - mean psi(n_c) - mean psi(m_i), at least 0.

Neighbours in one dimension are the k rows before and after in sorted
order. The rows are cut into value buckets (K1); inside a bucket the
neighbours come from a window over (class, bucket). The few rows within k
of a bucket edge take theirs from a second window over only those edge rows
per class (at most 2k rows per bucket), so no class ever sits in one task.
The range counts are K1 prefix counts over the points merged with two probe
values per point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import digamma, unit_noise
from quarry.operators.kernels import bucket_count, bucketize, cut_points, prefix_below

# Relative shrink of the radius so that x +/- r in floating point never
# counts the neighbour that defines r (it lies exactly on the boundary).
RADIUS_GUARD = 4e-15
COPY_BLOCK = 100_000       # equal rows that one task numbers
CLASS_BROADCAST = 10_000   # a class table of more rows is left to AQE


def scaled_jittered(df: DataFrame, x: str, key: str, seed, jitter: bool, tag: str) -> DataFrame:
    """x / std_pop(x) plus the deterministic jitter; two numbers come back
    to the driver (std and mean |x/std|)."""
    st = df.agg(F.stddev_pop(x).alias("s"), F.avg(F.abs(F.col(x))).alias("m")).first()
    s = st["s"] if st["s"] and st["s"] > 0 else 1.0
    xs = F.col(x) / F.lit(s)
    if not jitter:
        return df.withColumn("__x", xs)
    amp = 1e-10 * max(1.0, (st["m"] or 0.0) / s)
    return df.withColumn("__x", xs + F.lit(amp) * unit_noise(seed, F.lit(tag), key))


def sorted_neighbours(d: DataFrame, group: str, k: int, cuts, carry=()) -> DataFrame:
    """Adds ``nb_1..nb_2k``: the values of the k previous and k next rows in
    __x order within ``group`` (NULL where none), exactly, without a
    single-task window per group. For every column c in ``carry`` the
    neighbours' values come as ``c_nb_1..c_nb_2k``.

    A row r1-th from its bucket's start has its j-th predecessor inside the
    bucket when j < r1; otherwise the predecessor lies in an earlier bucket
    and the row is one of the first k of its bucket. Those edge rows (the
    first and last k of every bucket) are ordered once more per group, and
    there the j-th previous edge row is the true j-th predecessor. The same
    holds for successors from the end of the bucket.
    """
    b = bucketize(d, "__x", cuts, "__b")
    wb = Window.partitionBy(group, "__b").orderBy("__x", "__key")
    b = b.withColumn("__r1", F.row_number().over(wb)) \
         .withColumn("__r2", F.count(F.lit(1)).over(Window.partitionBy(group, "__b")) - F.col("__r1") + 1)
    cols = ["__x", *carry]
    for j in range(1, k + 1):
        for c in cols:
            b = b.withColumn(f"__p{j}_{c}", F.lag(c, j).over(wb)).withColumn(f"__n{j}_{c}", F.lead(c, j).over(wb))

    def name(c, j):
        return f"nb_{j}" if c == "__x" else f"{c}_nb_{j}"

    edge = (F.col("__r1") <= k) | (F.col("__r2") <= k)
    keep = [c for c in d.columns]
    inner = b.where(~edge).select(*keep, *[F.col(f"__p{j}_{c}").alias(name(c, j)) for j in range(1, k + 1) for c in cols],
                                  *[F.col(f"__n{j}_{c}").alias(name(c, k + j)) for j in range(1, k + 1) for c in cols])
    we = Window.partitionBy(group).orderBy("__b", "__x", "__key")
    e = b.where(edge)
    prevs = [F.when(F.lit(j) < F.col("__r1"), F.col(f"__p{j}_{c}")).otherwise(F.lag(c, j).over(we)).alias(name(c, j))
             for j in range(1, k + 1) for c in cols]
    nexts = [F.when(F.lit(j) < F.col("__r2"), F.col(f"__n{j}_{c}")).otherwise(F.lead(c, j).over(we))
             .alias(name(c, k + j)) for j in range(1, k + 1) for c in cols]
    edges = e.select(*keep, *prevs, *nexts)
    return inner.unionByName(edges)


def kth_distance(k_col: Column, k: int) -> Column:
    """k_col-th smallest of |x - nb_j| over the present neighbours."""
    ds = F.array(*[F.abs(F.col(f"nb_{j}") - F.col("__x")) for j in range(1, 2 * k + 1)])
    present = F.array_sort(F.filter(ds, lambda v: v.isNotNull()))
    return F.element_at(present, k_col.cast("int"))


def range_counts(points: DataFrame, probes: DataFrame, cuts) -> DataFrame:
    """For each probe (id, kind, v): the number of points strictly below v
    (kind 0) or at most v (kind 2). Points and probes are merged in one
    order (value, then kind: 0 < point 1 < 2) and counted by K1."""
    pts = points.select(F.col("__x").alias("v"), F.lit(1).alias("kind"), F.col("__key").alias("id"),
                        F.lit(1).alias("w"))
    prb = probes.select("v", "kind", "id", F.lit(0).alias("w"), "side")
    pts = pts.withColumn("side", F.lit(-1))
    u = bucketize(pts.unionByName(prb), "v", cuts, "__vb")
    r = prefix_below(u, [], "__vb", ["v", "kind", "id", "side"], "w", out="below", rows_bound=len(cuts) + 1)
    return r.where(F.col("w") == 0).select("id", "side", "below")


def mi_classif_feature(df: DataFrame, x: str, label: str, key: str, k: int = 3, seed=0,
                       jitter: bool = True) -> DataFrame:
    """D4 for one input; returns one row (feature, score). Intermediates are
    cached while it runs and released when the number is known."""
    from quarry.operators.kernels import Cached
    with Cached() as keep:
        score = _mi_classif(df, x, label, key, k, seed, jitter, keep)
    return df.sparkSession.createDataFrame([(x, score)], "feature string, score double")


def _mi_classif(df, x, label, key, k, seed, jitter, keep):
    if not jitter:
        return _mi_classif_by_value(df, x, label, k, keep)
    spark = df.sparkSession
    d = df.select(F.col(key).alias("__key"), F.col(x).cast("double").alias(x), F.col(label).alias("__c"))
    d = scaled_jittered(d, x, "__key", seed, jitter, x).select("__key", "__x", "__c")
    counts = d.groupBy("__c").agg(F.count(F.lit(1)).alias("__nc"))
    counts = keep(counts)
    d = keep(d.join(F.broadcast(counts) if counts.count() <= CLASS_BROADCAST else counts, "__c").where(F.col("__nc") > 1)
             .withColumn("__k", F.least(F.lit(k), F.col("__nc") - 1)))
    n = d.count()
    if n == 0:
        return None
    cuts = cut_points(d, ["__x"], bucket_count(spark, n))["__x"]
    nb = sorted_neighbours(d, "__c", k, cuts)
    r = kth_distance(F.col("__k"), k)
    rows = nb.select("__key", "__x", "__k", "__nc", r.alias("__r"))
    rg = F.col("__r") * (F.lit(1.0) - F.lit(RADIUS_GUARD)) - F.lit(RADIUS_GUARD) * F.abs(F.col("__x"))
    rows = rows.withColumn("__rg", F.greatest(rg, F.lit(0.0)))
    # strictly inside radius r; at r = 0 (ties without jitter) the points equal to x
    zero = F.col("__r") <= 0
    up = F.struct(F.when(zero, F.col("__x")).otherwise(F.col("__x") + F.col("__rg")).alias("v"),
                  F.when(zero, F.lit(2)).otherwise(F.lit(0)).alias("kind"), F.lit(0).alias("side"))
    lo = F.struct(F.when(zero, F.col("__x")).otherwise(F.col("__x") - F.col("__rg")).alias("v"),
                  F.when(zero, F.lit(0)).otherwise(F.lit(2)).alias("kind"), F.lit(1).alias("side"))
    probes = rows.select(F.col("__key").alias("id"), F.inline(F.array(up, lo)))
    cnt = range_counts(d, probes, cuts)
    m = cnt.groupBy("id").agg((F.sum(F.when(F.col("side") == 0, F.col("below")))
                               - F.sum(F.when(F.col("side") == 1, F.col("below")))).alias("__m"))
    j = rows.join(m, rows["__key"] == m["id"])
    mi = (digamma(F.lit(float(n))) + F.avg(digamma(F.col("__k").cast("double")))
          - F.avg(digamma(F.col("__nc").cast("double"))) - F.avg(digamma(F.col("__m").cast("double"))))
    return j.agg(F.greatest(mi, F.lit(0.0)).alias("score")).first()["score"]


def _mi_classif_by_value(df, x, label, k, keep):
    """D4 without jitter: equal values share radius and counts, so the work is done
    once per distinct (class, value). At most k + 1 copies of a value matter to a
    k-th neighbour, so a value held by a third of all rows is k + 1 rows here."""
    spark = df.sparkSession
    sd = df.agg(F.stddev_pop(F.col(x).cast("double")).alias("s")).first()["s"] or 1.0
    g = df.groupBy(F.col(label).alias("__c"), (F.col(x).cast("double") / F.lit(sd)).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    g = keep(g)
    classes = keep(g.groupBy("__c").agg(F.sum("__n").alias("__nc")).where(F.col("__nc") > 1))
    small = classes.count() <= CLASS_BROADCAST
    g = keep(g.join(F.broadcast(classes) if small else classes, "__c").withColumn("__k", F.least(F.lit(k), F.col("__nc") - 1)))
    n = g.agg(F.sum("__n")).first()[0]
    if not n:
        return None
    cuts = cut_points(g, ["__x"], bucket_count(spark, g.count()))["__x"]
    copies = g.withColumn("__key", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("__n"), F.lit(k + 1).cast("long")))))
    nb = sorted_neighbours(copies, "__c", k, cuts).where(F.col("__key") == 1)
    rows = nb.select("__c", "__x", "__n", "__k", "__nc", kth_distance(F.col("__k"), k).alias("__r"))
    guard = F.col("__r") * (F.lit(1.0) - F.lit(RADIUS_GUARD)) - F.lit(RADIUS_GUARD) * F.abs(F.col("__x"))
    rows = keep(rows.withColumn("__rg", F.when(F.col("__r") > 0, F.greatest(guard, F.lit(0.0))).otherwise(0.0)))
    # points of all classes strictly inside the radius; at radius 0 those equal to x
    zero = F.col("__r") <= 0
    ends = rows.select("__x", "__rg", (F.col("__x") + F.col("__rg")).alias("hi"), (F.col("__x") - F.col("__rg")).alias("lo"),
                       F.when(zero, 2).otherwise(0).alias("khi"), F.when(zero, 0).otherwise(2).alias("klo"))
    points = g.groupBy(F.col("__x").alias("v")).agg(F.sum("__n").alias("w")).withColumn("kind", F.lit(1))
    probes = ends.select(F.col("hi").alias("v"), F.col("khi").alias("kind")).union(ends.select("lo", "klo")).distinct()
    u = bucketize(points.unionByName(probes.withColumn("w", F.lit(0).cast("long"))), "v", cuts, "__vb")
    below = prefix_below(u, [], "__vb", ["v", "kind"], "w", out="below", rows_bound=len(cuts) + 1).where(F.col("kind") != 1).select("v", "kind", "below")
    up, lo = below.toDF("hi", "khi", "__up"), below.toDF("lo", "klo", "__lo")
    m = ends.distinct().join(up, ["hi", "khi"]).join(lo, ["lo", "klo"]).select("__x", "__rg", (F.col("__up") - F.col("__lo")).alias("__m"))
    j = rows.join(m, ["__x", "__rg"])
    mean = lambda c: F.sum(digamma(F.col(c).cast("double")) * F.col("__n")) / F.sum("__n")
    mi = digamma(F.lit(float(n))) + mean("__k") - mean("__nc") - mean("__m")
    return j.agg(F.greatest(mi, F.lit(0.0)).alias("score")).first()["score"]


def mutual_information(prep, task: str, k: int = 3, seed=0, jitter: bool = True, key: str | None = None):
    """D3/D4 over every used input of a prepared frame; one row per input.
    Fewer than 3 rows give NULL scores (the reference fails there)."""
    spark = prep.frame.sparkSession
    if prep.rows_used < 3 or not prep.used:
        return spark.createDataFrame([(f, None) for f in prep.used], "feature string, score double")
    frame = prep.frame
    if key is None:
        key = prep.extra.get("key")
    if jitter and (key is None or key not in frame.columns):
        # a key from the row's own values: the score must not depend on how the
        # table is partitioned; equal rows are counted, then numbered block by block
        columns = frame.columns
        values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
        copies = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__rowhash", F.md5(F.concat_ws("\x1f", *values)))
        last = (F.col("__n") - 1) / COPY_BLOCK
        copies = copies.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last)))).repartition("__rowhash", "__block")
        first = F.col("__block") * COPY_BLOCK + 1
        nth = F.explode(F.sequence(first, F.least("__n", first + COPY_BLOCK - 1))).alias("__nth")
        frame = copies.select(*columns, "__rowhash", nth)
        frame = frame.withColumn("__rowid", F.concat_ws(":", "__rowhash", F.col("__nth").cast("string"))).drop("__rowhash", "__nth").persist()
        key = "__rowid"
    kk = min(k, max(1, prep.rows_used - 1))
    if task == "regression":
        from quarry.operators.mi_reg import mi_regression
        scores = mi_regression(frame, prep.used, prep.target, key, kk, seed, jitter)
        rows = [(f, scores[f]) for f in prep.used]
    else:
        from quarry.session import run_parallel
        rows = run_parallel([lambda f=f: (f, mi_classif_feature(frame, f, prep.target, key, kk, seed, jitter).first()["score"])
                             for f in prep.used])
    if frame is not prep.frame:
        frame.unpersist()
    return spark.createDataFrame(rows, "feature string, score double")
