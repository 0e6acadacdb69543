"""Explanation (H1-H3).

H2 permutation importance runs as one job: the rows get their positions once
(K1), each repeat's permutation is an md5 order, rows and permuted values meet in
the md5's buckets, every (feature, repeat) variant of the table is scored by one
``transform``, and the metric is one aggregate grouped by (feature, repeat). H1 (tree SHAP) is in ``quarry.operators.shap``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import order_key
from quarry.operators import evaluate as ev
from quarry.operators.kernels import bounded_broadcast, hash_digits, hash_positions, require_keys
from quarry.session import cut_lineage


def _score(fitted, pred: DataFrame, by) -> DataFrame:
    """r2 for regression, support-weighted F1 for classes (as the reference)."""
    if fitted.task == "regression":
        return ev.regression_metrics(pred, by=by).select(*by, F.col("r2").alias("metric"))
    return ev.classification_metrics(pred, by=by).select(*by, F.col("f1").alias("metric"))


def _with_donors(base: DataFrame, n: int, key: str, repeats: int, seed, features, wanted) -> DataFrame:
    """(rep, ``wanted``, ``__d_`` values of ``features``): per repeat the row at each position of
    ``base`` (pos0) with the values of the row at that position of the repeat's md5 order.

    A repeat's order is cut into buckets by the md5's first digits; their counts (a bounded table)
    say which positions a bucket holds, so rows and donors are each sent once, to their bucket."""
    spark = base.sparkSession
    # buckets an eighth as large as those of K1: a task holds one as a whole
    digits = hash_digits(spark, 8 * n)
    reps = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    hashed = base.select(key, *features, reps.alias("rep")).withColumn("__h", order_key(seed, key, "rep"))
    donors = hashed.select("rep", F.substring("__h", 1, digits).alias("__hb"), F.unhex("__h").alias("__h"),
                           *[F.col(f).alias(f"__d_{i}") for i, f in enumerate(features)])
    counts = donors.groupBy("rep", "__hb").agg(F.count(F.lit(1)).alias("c")).collect()
    chunk = max(1, -(-n // 16**digits))
    ranges, at = [], dict.fromkeys(range(repeats), 0)
    for r in sorted(counts, key=lambda r: (r["rep"], r["__hb"])):
        low = at[r["rep"]]
        at[r["rep"]] = high = low + r["c"]
        ranges += [(c, r["rep"], r["__hb"], low, high) for c in range(low // chunk, (high - 1) // chunk + 1)]
    table = spark.createDataFrame(ranges, "__chunk long, rep int, __hb string, __low long, __high long")
    placed = base.withColumn("__chunk", F.floor(F.col("pos0") / F.lit(chunk)).cast("long")) \
        .join(bounded_broadcast(table, len(ranges)), "__chunk").where((F.col("pos0") >= F.col("__low")) & (F.col("pos0") < F.col("__high"))) \
        .select("rep", "__hb", "pos0", *wanted)
    fields = {f.name: f for f in [*placed.schema, *donors.schema]}
    names = ["rep", *wanted, *[f"__d_{i}" for i in range(len(features))]]

    def pair(rows: pa.Table, given: pa.Table) -> pa.Table:
        h = pa.concat_arrays(given["__h"].chunks).cast(pa.binary(16))
        words = np.frombuffer(h.buffers()[1], ">u8", 2 * len(h), 16 * h.offset).reshape(-1, 2)
        rows = rows.take(np.argsort(rows["pos0"].to_numpy(), kind="stable"))
        given = given.take(np.lexsort((words[:, 1], words[:, 0])))
        return pa.table({c: (given if c.startswith("__d_") else rows)[c] for c in names})

    return placed.groupBy("rep", "__hb").cogroup(donors.groupBy("rep", "__hb")) \
        .applyInArrow(pair, T.StructType([fields[c] for c in names]))


def permutation_importance(fitted, df: DataFrame, key: str, repeats: int = 10, seed=42,
                           features=None) -> DataFrame:
    """H2: mean drop of the score when one input is permuted, over
    ``repeats`` permutations. Returns (feature, importance, importance_std,
    baseline)."""
    features = list(features or fitted.inputs)
    t = fitted.target
    data = df.select(key, *fitted.inputs, t).dropna(how="any", subset=[*fitted.inputs, t])
    n = require_keys(data, key)
    base = cut_lineage(hash_positions(data, f"{seed}:base", key, out="pos0", n_rows=n))
    data = base.drop("pos0")
    j = _with_donors(base, n, key, int(repeats), seed, features, [*([key] if fitted.kind == "knn" else []), *fitted.inputs, t])
    variants = F.array(*[F.struct(F.lit(f).alias("feature"),
                                  *[(F.col(f"__d_{i}") if g == f else F.col(g)).alias(g) for g in fitted.inputs])
                         for i, f in enumerate(features)])
    perm = j.select(*([key] if fitted.kind == "knn" else []), "rep", t, F.inline(variants))
    scored = fitted.transform(perm).select("feature", "rep", F.col(t).alias("actual"),
                                            F.col(fitted.pred_col).alias("predicted"))
    per = _score(fitted, scored, ["feature", "rep"])
    b = _score(fitted, fitted.transform(data).select(F.col(t).alias("actual"),
                                                     F.col(fitted.pred_col).alias("predicted"),
                                                     F.lit(1).alias("__one")), ["__one"])
    baseline = b.first()["metric"]   # one number
    drop = per.withColumn("baseline", F.lit(baseline))
    drop = drop.withColumn("d", F.col("baseline") - F.col("metric"))
    return drop.groupBy("feature").agg(F.avg("d").alias("importance"), F.stddev_pop("d").alias("importance_std"),
                                       F.first("baseline").alias("baseline"))


def top_importance(imp: DataFrame, n: int = 20) -> DataFrame:
    """H3: the n most important features, descending (ties by name)."""
    return imp.orderBy(F.desc("importance"), "feature").limit(int(n))
