"""Evaluation as aggregations (F1-F8).

A prediction table has an actual and a predicted column and, usually, a
``split`` column; every metric is one grouped aggregate over it, so the
cost is one pass however many rows were scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.kernels import average_ranks, null_safe_join
from quarry.session import cut_lineage


def _by(by):
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       by="split") -> DataFrame:
    """r2 = 1 - SSE/SST, rmse, mae per group. SST comes from the
    population variance (a stable one-pass aggregate); a constant actual
    gives r2 = 1 when the fit is perfect, else 0."""
    e = F.col(actual) - F.col(predicted)
    g = pred.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        (F.var_pop(actual) * F.count(F.lit(1))).alias("sst"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"))
    r2 = F.when(F.col("sst") > 0, F.lit(1.0) - F.col("sse") / F.col("sst")) \
          .otherwise(F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.select(*_by(by), r2.alias("r2"), "rmse", "mae", "n")


def confusion_counts(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     by="split") -> DataFrame:
    """F4 (long form): count per (actual, predicted)."""
    return pred.groupBy(*_by(by), actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                           by="split") -> DataFrame:
    """F2: accuracy and support-weighted precision, recall and F1 (0 where a
    class is never predicted). Built from the confusion counts, a table of
    at most classes^2 rows per group."""
    keys = _by(by)
    cc = confusion_counts(pred, actual, predicted, by)
    hit = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)
    sup = cc.groupBy(*keys, F.col(actual).alias("cls")).agg(F.sum("n").alias("support"),
                                                            F.sum(hit).alias("tp"))
    prd = cc.groupBy(*keys, F.col(predicted).alias("cls")).agg(F.sum("n").alias("pred_n"))
    per = sup.join(prd, keys + ["cls"], "left")
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("pred_n")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    per = per.select(*keys, "support", "tp", p.alias("p"), r.alias("r"), f1.alias("f1"))
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
        F.sum("support").alias("n"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", positive=1,
            by=None) -> DataFrame:
    """exact ROC AUC in the Mann-Whitney form, (sum of positive average
    ranks - P(P+1)/2) / (P N), with tie-averaged ranks from kernel K1.
    Scores are pre-aggregated per (group, score, class), so repeated scores
    cost one row each; NULL when a group has one class only. A row without label
    or score (or with a NaN score) is left out; a NULL group is a group."""
    keys = _by(by)
    scored = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    pos = (F.col(label) == F.lit(positive)).cast("long")
    s = scored.select(*keys, F.col(score).cast("double").alias("__s"), pos.alias("__p"))
    # read by the cut points, the bucket totals, the ranks and the last join
    per = cut_lineage(s.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__n"), F.sum("__p").alias("__np")))
    ranks = average_ranks(per, "__s", group_cols=keys, count_col="__n", groups_bound=1 if not keys else None)
    j = null_safe_join(ranks, per, keys + ["__s"])
    g = j.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("__np")).alias("rs"),
                             F.sum("__np").alias("P"), F.sum(F.col("__n") - F.col("__np")).alias("N"))
    auc = F.try_divide(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0, F.col("P") * F.col("N"))
    return g.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), auc).alias("roc_auc"))


def confusion_matrix(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     labels=None) -> DataFrame:
    """a square table: one row and one column per label, sorted, zero where
    a pair does not occur. The labels are those of both columns, or given
    (then a label that this part of the data lacks keeps its row). They become
    columns, so their number is bounded by what a schema can hold; for more,
    ``confusion_counts`` is the long form."""
    cc = confusion_counts(pred, actual, predicted, by=None)
    if labels is None:
        # the counts hold one row per pair of labels, so this reads no row twice
        both = cc.select(F.col(actual).alias("l")).union(cc.select(F.col(predicted).alias("l")))
        labels = [r[0] for r in both.where("l IS NOT NULL").distinct().orderBy("l").collect()]
    labels = list(labels)
    rows = pred.sparkSession.createDataFrame([(v,) for v in labels], f"actual {pred.schema[actual].dataType.simpleString()}")
    wide = cc.where(F.col(actual).isNotNull()).groupBy(F.col(actual).alias("actual")).pivot(predicted, labels).agg(F.sum("n"))
    cell = lambda v: F.coalesce(F.col(f"`{v}`").cast("long"), F.lit(0).cast("long")).alias(str(v))
    return rows.join(wide, "actual", "left").select("actual", *[cell(v) for v in labels])


def cv_summary(fold_metrics: DataFrame, cols) -> DataFrame:
    """mean and population std of per-fold metrics."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return fold_metrics.agg(*aggs)


def parity(train_pred: DataFrame, test_pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual and predicted of both splits, tagged and stacked."""
    t = train_pred.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
                          F.lit("train").alias("split"))
    s = test_pred.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
                         F.lit("test").alias("split"))
    return t.unionByName(s)


def parity_range(par: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """common axis limits: min and max over both columns, widened by 2 %
    of the span (by 1 when the span is 0)."""
    lo = F.least(F.min(actual), F.min(predicted))
    hi = F.greatest(F.max(actual), F.max(predicted))
    g = par.agg(lo.alias("lo"), hi.alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.02).otherwise(F.lit(1.0))
    return g.select((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def parity_density(par: DataFrame, bins: int = 50, actual: str = "actual",
                   predicted: str = "predicted") -> DataFrame:
    """F7 re-aimed: a bins x bins density table over the common range instead
    of a scatter of every point. The range is one row of two numbers."""
    rng = parity_range(par, actual, predicted).first()
    lo, hi = rng["lo"], rng["hi"]
    width = (hi - lo) / float(bins) if hi is not None and hi > lo else 1.0
    lo = lo if lo is not None else 0.0
    bx = F.least(F.floor((F.col(actual) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    by_ = F.least(F.floor((F.col(predicted) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return par.groupBy(bx.alias("actual_bin"), by_.alias("predicted_bin")).agg(F.count(F.lit(1)).alias("n"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """F8: rows per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
