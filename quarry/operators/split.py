"""Splits and folds (C1-C5, C6 in params).

Every split adds a ``split`` column ('train' / 'test'); every fold operator
adds a ``fold`` column. Orders are md5(seed:key) orders (T9), so each split
has an exact SQL oracle. A split finds the order value at its boundary (one
per class or group table) from counts, then marks the rows by comparing with
it: the table itself is never shuffled or sorted. Sizes follow the reference:
the test side gets ceil(n * test_size) rows (or groups).

No row is lost: a NULL class or group is one of its own, and a NULL key or
order value is an error that names the column. Rows with equal keys fall on
the same side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import order_key
from quarry.operators.kernels import (hash_positions, last_of_first, nth_values, null_safe_join, order_values,
                                      require_keys)

SPLIT_METHODS = ("random", "stratified", "group", "time")
NULL_GROUP = "<null>"       # how the md5 order writes a NULL group
BROADCAST_CLASSES = 10_000  # a class table of more rows than this is left to AQE


def _n_test(n: int, test_size: float) -> int:
    if isinstance(test_size, int) and test_size >= 1:
        return int(test_size)
    return int(math.ceil(test_size * n))


def split_random(df: DataFrame, test_size: float = 0.2, seed=42, key="id") -> DataFrame:
    """Exact-size random split: the ceil(n * test_size) rows first in
    md5(seed:key) order are the test side."""
    n = require_keys(df, key)
    return _first_hashes(df, order_key(seed, key), _n_test(n, test_size), n)


def _first_hashes(df: DataFrame, h, k: int, n: int, of: DataFrame | None = None, of_h=None) -> DataFrame:
    """``df`` with test = the md5s ``h`` up to the k-th smallest (of ``of``'s)."""
    if k <= 0:
        return df.withColumn("split", F.lit("train"))
    base = (df if of is None else of).withColumn("__all", F.lit(0))
    quota = df.sparkSession.range(1).select(F.lit(0).alias("__all"), F.lit(int(min(k, n))).cast("long").alias("quota"))
    last = last_of_first(base, h if of is None else of_h, quota, "__all", n).first()
    if last is None:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(h <= F.lit(last["last"]), "test").otherwise("train"))


def class_quotas(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """Per-class test counts for a stratified split (a table with one row per
    class). The train side takes floor(count * n_train / n) per class plus
    one more for the classes with the largest remainders (ties by class), so
    the total is exact; the test side takes the rest of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    tot = Window.partitionBy()
    n = F.sum("cnt").over(tot)
    n_test = F.ceil(n * F.lit(float(test_size))) if test_size < 1 else F.lit(int(test_size))
    q = counts.withColumn("n", n).withColumn("n_train", F.col("n") - n_test)
    q = q.withColumn("exact", F.col("cnt") * F.col("n_train") / F.col("n")) \
         .withColumn("floor", F.floor("exact")) \
         .withColumn("rem", F.col("exact") - F.col("floor"))
    q = q.withColumn("need", F.col("n_train") - F.sum("floor").over(tot))
    q = q.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rem"), F.col(label).asc_nulls_last())))
    q = q.withColumn("train_q", F.col("floor") + F.when(F.col("r") <= F.col("need"), 1).otherwise(0))
    return q.select(label, "cnt", (F.col("cnt") - F.col("train_q")).cast("long").alias("test_q"))


def split_stratified(df: DataFrame, label: str, test_size: float = 0.2, seed=42, key="id") -> DataFrame:
    """Exact total test size with per-class proportions; within each
    class the first ``test_q`` rows in md5 order are test. A class with a
    single row cannot be split: it raises, naming the class."""
    quotas = class_quotas(df, label, test_size).persist()
    lonely = quotas.where(F.col("cnt") < 2).select(label).limit(5).collect()
    if lonely:
        raise ValueError(f"class(es) with a single row cannot be stratified: {[r[0] for r in lonely]}")
    n = require_keys(df, key)
    wanted = quotas.where("test_q > 0").select(label, F.col("test_q").alias("quota"))
    edges = last_of_first(df, order_key(seed, key), wanted, label, n).persist()
    out = null_safe_join(df, F.broadcast(edges) if edges.count() <= BROADCAST_CLASSES else edges, [label], "left")
    quotas.unpersist()
    inside = F.coalesce(order_key(seed, key) <= F.col("last"), F.lit(False))
    return out.withColumn("split", F.when(inside, "test").otherwise("train")).drop("last")


def split_group(df: DataFrame, group_col: str, test_size: float = 0.2, seed=42) -> DataFrame:
    """ceil(n_groups * test_size) groups, first in md5(seed:group) order,
    form the test side; no group is on both sides. The boundary md5 comes from
    the distinct groups; rows compare their own group's md5 with it."""
    groups = df.select(group_col).distinct()
    ng = groups.count()
    h = order_key(seed, F.coalesce(F.col(group_col).cast("string"), F.lit(NULL_GROUP)))
    return _first_hashes(df, h, _n_test(ng, test_size), ng, groups, h)


def split_time(df: DataFrame, order_cols, test_size: float = 0.2, mode: str = "first_fold") -> DataFrame:
    """C4: ordered split. ``first_fold`` follows the reference's first time-series
    fold: k = int(1 / test_size), fold = n // (k + 1); train is the first
    n - k * fold rows and test the next fold (later rows are unused and
    dropped). ``holdout`` makes the last ceil(n * test_size) rows test."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    n = require_keys(df, order_cols)
    if mode == "holdout":
        n_train, n_used = n - _n_test(n, test_size), n
    elif mode == "first_fold":
        splits = int(1 / test_size)
        n_train = n - splits * (n // (splits + 1))
        n_used = n_train + n // (splits + 1)
    else:
        raise ValueError("mode must be 'first_fold' or 'holdout'")
    values = order_values(df, order_cols)
    cuts = nth_values(df, order_cols, {p for p in (n_train - 1, n_used - 1) if 0 <= p < n})

    def upto(place):
        """The row's order tuple is not above that of the row at ``place``."""
        if place < 0:
            return F.lit(False)
        out = F.lit(True)
        for v, edge in zip(reversed(values), reversed(cuts[place]), strict=True):
            out = (v < F.lit(edge)) | ((v == F.lit(edge)) & out)
        return out

    used = df if n_used >= n else df.where(upto(n_used - 1))
    return used.withColumn("split", F.when(upto(n_train - 1), "train").otherwise("test"))


def split_train_test(df: DataFrame, method: str = "random", test_size: float = 0.2, seed=42,
                     key="id", stratify_col=None, group_col=None, order_cols=None) -> DataFrame:
    """One of the four splits by name."""
    ways = {"random": (key, lambda: split_random(df, test_size, seed, key)),
            "stratified": (stratify_col, lambda: split_stratified(df, stratify_col, test_size, seed, key)),
            "group": (group_col, lambda: split_group(df, group_col, test_size, seed)),
            "time": (order_cols or key, lambda: split_time(df, order_cols or [key], test_size))}
    if method not in ways:
        raise ValueError(f"unknown split {method!r}: one of {', '.join(ways)}")
    column, run = ways[method]
    if column is None:
        raise ValueError(f"a {method} split needs its column")
    return run()


def kfold(df: DataFrame, k: int = 5, seed=42, key="id", label: str | None = None) -> DataFrame:
    """``fold`` = position mod k in md5 order (within each class when
    ``label`` is given), so folds have near-equal sizes and stratified folds
    keep class proportions."""
    n = require_keys(df, key)
    classes = df.select(label).distinct().count() if label else 1
    pos = hash_positions(df, seed, key, group_cols=[label] if label else [], n_rows=n, n_groups=classes)
    return pos.withColumn("fold", (F.col("pos") % F.lit(int(k))).cast("int")).drop("pos")


def stratified_fold_count(df: DataFrame, label: str, max_folds: int = 5) -> int:
    """k = clamp(smallest class count, 2, max_folds), as the reference's CV."""
    m = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return max(2, min(max_folds, int(m)))
