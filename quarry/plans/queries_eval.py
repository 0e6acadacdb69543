"""Registered queries for evaluation (F1-F8).

The predictions come from models with closed forms that both engines can
compute: a least-squares line (``regr_slope`` / ``regr_intercept``) fitted
on the train split of ``part``, and a per-user majority class fitted on the
train split of ``events``. The metric operators are what is checked.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators import split
from quarry.plans.catalog import load, register, rounded

PART_SPLIT = """s AS (SELECT p.*, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey::VARCHAR), p_partkey) - 1 AS pos,
  count(*) OVER () AS n FROM part) p)"""
PART_PRED = PART_SPLIT + """,
c AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
  FROM s WHERE split = 'train'),
p AS (SELECT s.p_partkey, s.split, s.p_retailprice AS actual, c.a + c.b * s.p_size AS predicted FROM s, c)"""

EV_SPLIT = """s AS (SELECT e.*, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS pos,
  count(*) OVER () AS n FROM events) e)"""
EV_PRED = EV_SPLIT + """,
m AS (SELECT user_id, event_type AS pred FROM (SELECT user_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
  FROM s WHERE split = 'train' GROUP BY user_id, event_type) WHERE r = 1),
g AS (SELECT event_type AS gpred FROM s WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1),
p AS (SELECT s.event_id, s.split, s.event_type AS actual, coalesce(m.pred, (SELECT gpred FROM g)) AS predicted
  FROM s LEFT JOIN m USING (user_id))"""


def part_predictions(spark, sf):
    """(p_partkey, split, actual, predicted) from a line fitted on train."""
    s = split.split_random(load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"),
                           0.2, 42, "p_partkey")
    c = s.where("split = 'train'").agg(F.regr_slope("p_retailprice", "p_size").alias("b"),
                                       F.regr_intercept("p_retailprice", "p_size").alias("a")).first()
    return s.select("p_partkey", "split", F.col("p_retailprice").alias("actual"),
                    (F.lit(c["a"]) + F.lit(c["b"]) * F.col("p_size")).alias("predicted"))


def event_predictions(spark, sf):
    """(event_id, split, actual, predicted): majority class of the user on
    train, else the overall majority class."""
    s = split.split_random(load(spark, sf, "events").select("event_id", "user_id", "event_type"),
                           0.2, 42, "event_id")
    tr = s.where("split = 'train'")
    per = tr.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("user_id").orderBy(F.desc("c"), "event_type")
    m = per.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", F.col("event_type").alias("pred"))
    g = tr.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").first()["event_type"]
    return s.join(m, "user_id", "left").select(
        "event_id", "split", F.col("event_type").alias("actual"),
        F.coalesce(F.col("pred"), F.lit(g)).alias("predicted"))


register("F1_regression_metrics", "WITH " + PART_PRED + """
SELECT split, round(CASE WHEN var_pop(actual) * count(*) > 0
    THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END, 6) + 0.0 AS r2,
  round(sqrt(avg((actual - predicted) ^ 2)), 6) + 0.0 AS rmse,
  round(avg(abs(actual - predicted)), 6) + 0.0 AS mae, count(*) AS n
FROM p GROUP BY split
""")(lambda spark, sf: rounded(ev.regression_metrics(part_predictions(spark, sf))))

register("F2_classification_metrics", "WITH " + EV_PRED + """,
cc AS (SELECT split, actual, predicted, count(*) AS n FROM p GROUP BY ALL),
sup AS (SELECT split, actual AS cls, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
  FROM cc GROUP BY ALL),
prd AS (SELECT split, predicted AS cls, sum(n) AS pred_n FROM cc GROUP BY ALL),
per AS (SELECT sup.split, support, tp, coalesce(tp / pred_n, 0) AS pp, coalesce(tp / support, 0) AS rr
  FROM sup LEFT JOIN prd USING (split, cls)),
per2 AS (SELECT *, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END AS f1 FROM per)
SELECT split, round(sum(tp) / sum(support), 6) + 0.0 AS accuracy,
  round(sum(pp * support) / sum(support), 6) + 0.0 AS precision,
  round(sum(rr * support) / sum(support), 6) + 0.0 AS recall,
  round(sum(f1 * support) / sum(support), 6) + 0.0 AS f1, sum(support)::BIGINT AS n
FROM per2 GROUP BY split
""")(lambda spark, sf: rounded(ev.classification_metrics(event_predictions(spark, sf))))

register("F3_roc_auc", """
WITH t AS (SELECT l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM t)
SELECT round((sum(rk) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0)
  / (sum(quality) * (count(*) - sum(quality))), 6) + 0.0 AS roc_auc FROM r
""")(lambda spark, sf: rounded(ev.roc_auc(
    load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id"), "quality", "n_chars", 1)))

register("F3_roc_auc_by_split", """
WITH t0 AS (SELECT l.quality, d.n_chars, l.doc_id FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) - 1
  < ceil(count(*) OVER () * 0.3) THEN 'test' ELSE 'train' END AS split FROM t0),
r AS (SELECT split, quality, rank() OVER (PARTITION BY split ORDER BY n_chars)
  + (count(*) OVER (PARTITION BY split, n_chars) - 1) / 2.0 AS rk FROM t)
SELECT split, round((sum(rk) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0)
  / (sum(quality) * (count(*) - sum(quality))), 6) + 0.0 AS roc_auc FROM r GROUP BY split
""")(lambda spark, sf: rounded(ev.roc_auc(
    split.split_random(load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id"), 0.3, 3, "doc_id"),
    "quality", "n_chars", 1, by="split")))

def _auc_nulls(spark, sf):
    """F3 with rows that lack a label or a score, and a NULL group."""
    t = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id")
    return rounded(ev.roc_auc(t.select(F.when(F.col("doc_id") % 5 > 0, F.col("quality")).alias("quality"),
                                       F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")).alias("n_chars"),
                                       F.when(F.col("lang") != "en", F.col("lang")).alias("lang")), "quality", "n_chars", 1, by="lang"))


register("F3_roc_auc_null_labels", """
WITH t AS (SELECT CASE WHEN lang <> 'en' THEN lang END AS lang, quality, n_chars FROM labels JOIN documents USING (doc_id)
  WHERE doc_id % 5 > 0 AND doc_id % 7 > 0 AND quality IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM t)
SELECT lang, CASE WHEN sum(quality) > 0 AND sum(quality) < count(*) THEN round((sum(rk) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0)
  / (sum(quality) * (count(*) - sum(quality))), 6) + 0.0 END AS roc_auc FROM r GROUP BY lang
""")(_auc_nulls)

register("F4_confusion_matrix", "WITH " + EV_PRED + """
SELECT actual, count(*) FILTER (WHERE predicted = 'click') AS click,
  count(*) FILTER (WHERE predicted = 'error') AS error,
  count(*) FILTER (WHERE predicted = 'purchase') AS purchase,
  count(*) FILTER (WHERE predicted = 'signup') AS signup,
  count(*) FILTER (WHERE predicted = 'view') AS view
FROM p GROUP BY actual
""")(lambda spark, sf: ev.confusion_matrix(event_predictions(spark, sf)))


def _confusion_unseen(spark, sf):
    """A label that is predicted but never actual still has its row."""
    p = event_predictions(spark, sf).where("actual <> 'click'")
    return ev.confusion_matrix(p.withColumn("predicted", F.when(F.col("event_id") % 50 == 0, "zero").otherwise(F.col("predicted"))))


register("F4_confusion_matrix_square", "WITH " + EV_PRED + """,
q AS (SELECT actual, CASE WHEN event_id % 50 = 0 THEN 'zero' ELSE predicted END AS predicted FROM p WHERE actual <> 'click'),
l AS (SELECT DISTINCT unnest([actual, predicted]) AS actual FROM q)
SELECT l.actual, count(*) FILTER (WHERE predicted = 'click') AS click, count(*) FILTER (WHERE predicted = 'error') AS error,
  count(*) FILTER (WHERE predicted = 'purchase') AS purchase, count(*) FILTER (WHERE predicted = 'signup') AS signup,
  count(*) FILTER (WHERE predicted = 'view') AS view, count(*) FILTER (WHERE predicted = 'zero') AS zero
FROM l LEFT JOIN q USING (actual) GROUP BY l.actual
""")(_confusion_unseen)


def _cv_line(spark, sf):
    """F5 on the whole of ``part``: 5 folds of a least-squares line."""
    from quarry.plans.train import cross_validate
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(cross_validate(d, "p_retailprice", ["p_size"], "regression", "linear", "core", 42, "p_partkey"))


register("F5_cross_validate", """
WITH d AS (SELECT *, ((row_number() OVER (ORDER BY md5('42:' || p_partkey::VARCHAR), p_partkey) - 1) % 5) AS fold
  FROM part),
st AS (SELECT fold, count(*) AS n, sum(p_size::DOUBLE) AS sx, sum(p_retailprice) AS sy,
  sum(p_size::DOUBLE * p_size) AS sxx, sum(p_size * p_retailprice) AS sxy FROM d GROUP BY fold),
t AS (SELECT fold, sum(n) OVER () - n AS tn, sum(sx) OVER () - sx AS tsx, sum(sy) OVER () - sy AS tsy,
  sum(sxx) OVER () - sxx AS tsxx, sum(sxy) OVER () - sxy AS tsxy FROM st),
c AS (SELECT fold, (tn * tsxy - tsx * tsy) / (tn * tsxx - tsx * tsx) AS b, tsy, tsx, tn FROM t),
c2 AS (SELECT fold, b, (tsy - b * tsx) / tn AS a FROM c),
p AS (SELECT d.fold, p_retailprice AS actual, a + b * p_size AS predicted FROM d JOIN c2 USING (fold)),
m AS (SELECT fold, 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) AS r2,
  avg(abs(actual - predicted)) AS mae FROM p GROUP BY fold)
SELECT round(avg(r2), 6) + 0.0 AS r2_mean, round(stddev_pop(r2), 6) + 0.0 AS r2_std,
  round(avg(mae), 6) + 0.0 AS mae_mean, round(stddev_pop(mae), 6) + 0.0 AS mae_std, 5 AS folds FROM m
""")(_cv_line)

def _parity(spark, sf):
    p = part_predictions(spark, sf)
    return rounded(ev.parity(p.where("split = 'train'"), p.where("split = 'test'"), "actual", "predicted"))


register("F6_parity", "WITH " + PART_PRED + """
SELECT split, round(actual, 6) + 0.0 AS actual, round(predicted, 6) + 0.0 AS predicted FROM p
""")(_parity)

register("F7_parity_range", "WITH " + PART_PRED + """,
g AS (SELECT least(min(actual), min(predicted)) AS lo, greatest(max(actual), max(predicted)) AS hi FROM p)
SELECT round(lo - CASE WHEN hi > lo THEN (hi - lo) * 0.02 ELSE 1 END, 6) + 0.0 AS lo,
  round(hi + CASE WHEN hi > lo THEN (hi - lo) * 0.02 ELSE 1 END, 6) + 0.0 AS hi FROM g
""")(lambda spark, sf: rounded(ev.parity_range(part_predictions(spark, sf))))

register("F7_parity_density", "WITH " + PART_PRED + """,
g AS (SELECT least(min(actual), min(predicted)) AS lo0, greatest(max(actual), max(predicted)) AS hi0 FROM p),
r AS (SELECT lo0 - (hi0 - lo0) * 0.02 AS lo, hi0 + (hi0 - lo0) * 0.02 AS hi FROM g)
SELECT least(floor((actual - lo) / ((hi - lo) / 10.0)), 9)::INTEGER AS actual_bin,
  least(floor((predicted - lo) / ((hi - lo) / 10.0)), 9)::INTEGER AS predicted_bin, count(*) AS n
FROM p, r GROUP BY ALL
""")(lambda spark, sf: ev.parity_density(part_predictions(spark, sf), bins=10))

register("F8_split_counts", "WITH " + PART_SPLIT + """
SELECT split, count(*) AS n FROM s GROUP BY split
""")(lambda spark, sf: ev.split_counts(split.split_random(load(spark, sf, "part"), 0.2, 42, "p_partkey")))
