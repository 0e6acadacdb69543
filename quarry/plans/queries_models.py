"""Registered queries for models (E), the train job (F9/F10), scoring (G)
and saved runs (A1, A3-A10).

Linear models with one input have closed forms, so their coefficients have
SQL oracles (OLS by regr_*, ridge, and soft-thresholded lasso and elastic
net on the population-standardised input). Trees, logistic regression and
the kernel approximation are iterative: their queries are rows-only, and
their properties are tested in tests/.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import models, split
from quarry.plans import score as sc
from quarry.plans.catalog import load, register, rounded
from quarry.plans.queries_eval import PART_SPLIT
from quarry.plans.train import train_model
from quarry.sources import runs, sinks
from quarry.sources.tables import read_table


def _part_split(spark, sf):
    return split.split_random(load(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand", "p_type"),
        0.2, 42, "p_partkey")


def _coefs(fitted):
    est = fitted.pipeline.stages[-1]
    return [("intercept", float(est.intercept))] + list(zip(fitted.feature_names(),
                                                             [float(v) for v in est.coefficients]))


def _coef_query(kind, profile="core"):
    def q(spark, sf):
        tr = _part_split(spark, sf).where("split = 'train'")
        m = models.fit(tr, "p_retailprice", ["p_size"], "regression", kind, profile)
        return rounded(spark.createDataFrame(_coefs(m), "term string, value double"))
    return q


_TRAIN = "WITH " + PART_SPLIT + """,
t AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM s WHERE split = 'train'),
m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy,
  sum((x - (SELECT avg(x) FROM t)) ^ 2) AS sxx, count(*) AS n FROM t)"""

register("E1_linear", "WITH " + PART_SPLIT + """
SELECT term, round(value, 6) + 0.0 AS value FROM (
  SELECT 'intercept' AS term, regr_intercept(p_retailprice, p_size) AS value FROM s WHERE split = 'train'
  UNION ALL SELECT 'p_size', regr_slope(p_retailprice, p_size) FROM s WHERE split = 'train')
""")(_coef_query("linear"))

register("E2_ridge", _TRAIN + """,
c AS (SELECT cxy * n / (sxx + 1.0) AS b, mx, my FROM m)
SELECT term, round(value, 6) + 0.0 AS value FROM (
  SELECT 'intercept' AS term, my - b * mx AS value FROM c UNION ALL SELECT 'p_size', b FROM c)
""")(_coef_query("ridge"))

register("E3_lasso_gui", _TRAIN + """,
c AS (SELECT sign(cxy / sx) * greatest(abs(cxy / sx) - 0.001, 0) AS b, my FROM m)
SELECT term, round(value, 6) + 0.0 AS value FROM (
  SELECT 'intercept' AS term, my AS value FROM c UNION ALL SELECT 'p_size', b FROM c)
""")(_coef_query("lasso", "gui"))

register("E4_elasticnet_gui", _TRAIN + """,
c AS (SELECT sign(cxy / sx) * greatest(abs(cxy / sx) - 0.0005, 0) / (1 + 0.0005) AS b, my FROM m)
SELECT term, round(value, 6) + 0.0 AS value FROM (
  SELECT 'intercept' AS term, my AS value FROM c UNION ALL SELECT 'p_size', b FROM c)
""")(_coef_query("elasticnet", "gui"))


def _pred_query(task, kind, profile="core", table="part", **params):
    """Fit on the train split of a whole table, predict its test split."""
    def q(spark, sf):
        if table == "part":
            d = _part_split(spark, sf)
            target, inputs, key = "p_retailprice", ["p_size", "p_brand", "p_type"], "p_partkey"
        elif table == "labels":
            d0 = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id") \
                .select("doc_id", "n_chars", "lang", "quality")
            d = split.split_stratified(d0, "quality", 0.2, 42, "doc_id")
            target, inputs, key = "quality", ["n_chars", "lang"], "doc_id"
        else:
            d0 = load(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
            d = split.split_stratified(d0, "event_type", 0.2, 42, "event_id")
            target, inputs, key = "event_type", ["value", "user_id"], "event_id"
        m = models.fit(d.where("split = 'train'"), target, inputs, task, kind, profile, **params)
        return m.transform(d.where("split = 'test'")).select(key, target, m.pred_col)
    return q


register("E5_rf")(_pred_query("regression", "rf"))
register("E6_hgb")(_pred_query("regression", "hgb"))
register("E7_xgb")(_pred_query("regression", "xgb"))
register("E8_svr_rff")(_pred_query("regression", "svr", "gui"))
register("E10_logistic")(_pred_query("classification", "linear", table="labels"))
register("E11_ridge_clf")(_pred_query("classification", "ridge", table="labels"))
register("E12_rf_clf")(_pred_query("classification", "rf", table="events"))
register("E13_hgb_clf")(_pred_query("classification", "hgb", table="labels"))
register("E13_hgb_clf_multiclass")(_pred_query("classification", "hgb", table="events"))


def _gradient_query(kind):
    """The penalised log loss is convex, so its gradient vanishes at the
    solution alone: emit it, per term, at the fitted coefficients."""
    def q(spark, sf):
        d = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id").select(
            "doc_id", "quality", (F.log1p("n_chars") - 7.0).alias("x"))
        m = models.fit(d, "quality", ["x"], "classification", kind)
        est = m.pipeline.stages[-1]
        b, a = float(est.coefficients[0]), float(est.intercept)
        e = 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x")))) - F.col("quality")
        g = d.agg(F.avg(e).alias("ga"), (F.avg(e * F.col("x")) + F.lit(b) / F.count(F.lit(1))).alias("gb"), F.count(F.lit(1)).alias("n"))
        return g.select(F.inline(F.array(
            F.struct(F.lit("intercept").alias("term"), (F.round("ga", 5) + 0.0).alias("gradient"), F.col("n").alias("n")),
            F.struct(F.lit("x").alias("term"), (F.round("gb", 5) + 0.0).alias("gradient"), F.col("n").alias("n")))))
    return q


_GRADIENT_SQL = """
WITH t AS (SELECT count(*) AS n FROM labels l JOIN documents d USING (doc_id))
SELECT 'intercept' AS term, 0.0::DOUBLE AS gradient, n FROM t UNION ALL SELECT 'x', 0.0::DOUBLE, n FROM t
"""
register("E10_logistic_gradient", _GRADIENT_SQL)(_gradient_query("linear"))
register("E11_ridge_clf_gradient", _GRADIENT_SQL)(_gradient_query("ridge"))


def _stump(kind):
    """One boosting round of depth 1 on p_size (50 values, every bin exact)."""
    def q(spark, sf):
        d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
        m = models.fit(d, "p_retailprice", ["p_size"], "regression", kind, rounds=1, depth=1, lr=1.0)
        return m.transform(d).select("p_partkey", (F.round("p_retailprice_pred", 4) + 0.0).alias("prediction"))
    return q


_STUMP_SQL = """
WITH v AS (SELECT p_size, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY p_size),
c AS (SELECT p_size, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v
  WINDOW w AS (ORDER BY p_size ROWS UNBOUNDED PRECEDING)),
b AS (SELECT p_size AS cut, sl / nl AS lv, (s - sl) / (n - nl) AS rv FROM c WHERE nl >= 20 AND n - nl >= 20
  ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, p_size LIMIT 1)
SELECT p_partkey, round(CASE WHEN p_size <= cut THEN lv ELSE rv END, 4) + 0.0 AS prediction FROM part, b
"""
register("E6_hgb_stump", _STUMP_SQL)(_stump("hgb"))


def _boosted_depth_two(spark, sf):
    """One boosting round of depth 2 on p_size with the L2 penalty 1."""
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    m = models.fit(d, "p_retailprice", ["p_size"], "regression", "xgb", rounds=1, depth=2, lr=1.0)
    return m.transform(d).select("p_partkey", (F.round("p_retailprice_pred", 4) + 0.0).alias("prediction"))


register("E7_xgb_stump", """
WITH t AS (SELECT p_partkey, p_size, p_retailprice - avg(p_retailprice) OVER () AS r, avg(p_retailprice) OVER () AS base FROM part),
v AS (SELECT p_size, count(*) AS n, sum(r) AS s FROM t GROUP BY p_size),
c AS (SELECT p_size, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v WINDOW w AS (ORDER BY p_size)),
b AS (SELECT p_size AS cut FROM c WHERE nl < n ORDER BY sl * sl / (nl + 1) + (s - sl) * (s - sl) / (n - nl + 1) DESC, p_size LIMIT 1),
c2 AS (SELECT p_size <= cut AS low, p_size, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER p AS n, sum(s) OVER p AS s FROM v, b
  WINDOW w AS (PARTITION BY p_size <= cut ORDER BY p_size), p AS (PARTITION BY p_size <= cut)),
b2 AS (SELECT low, p_size AS cut2, sl / (nl + 1) AS lv, (s - sl) / (n - nl + 1) AS rv FROM (SELECT *, row_number() OVER (PARTITION BY low
  ORDER BY sl * sl / (nl + 1) + (s - sl) * (s - sl) / (n - nl + 1) DESC, p_size) AS k FROM c2 WHERE nl < n) WHERE k = 1)
SELECT p_partkey, round(base + CASE WHEN p_size <= cut2 THEN lv ELSE rv END, 4) + 0.0 AS prediction
FROM t CROSS JOIN b JOIN b2 ON b2.low = (p_size <= cut)
""")(_boosted_depth_two)


def _forest_stump(spark, sf):
    """E5: one tree of depth 1 on all rows (no bootstrap sample)."""
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    m = models.fit(d, "p_retailprice", ["p_size"], "regression", "rf", trees=1, max_depth=1, min_leaf_share=0.0, bootstrap=False)
    return m.transform(d).select("p_partkey", (F.round("p_retailprice_pred", 4) + 0.0).alias("prediction"))


register("E5_rf_stump", _STUMP_SQL.replace("WHERE nl >= 20 AND n - nl >= 20", "WHERE nl < n"))(_forest_stump)


def _forest_clf_stump(spark, sf):
    """One tree of depth 1 on user_id, all rows: the split of least Gini impurity, each
    side its most frequent class."""
    d = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    m = models.fit(d, "event_type", ["user_id"], "classification", "rf", trees=1, max_depth=1, min_leaf_share=0.0, bootstrap=False)
    return m.transform(d).select("event_id", F.col(m.pred_col).alias("prediction"))


register("E12_rf_clf_stump", """
WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
u AS (SELECT DISTINCT user_id AS cut FROM events),
s AS (SELECT u.cut, v.event_type, sum(CASE WHEN v.user_id <= u.cut THEN n ELSE 0 END) AS l, sum(CASE WHEN v.user_id > u.cut THEN n ELSE 0 END) AS r
  FROM u, v GROUP BY ALL),
g AS (SELECT cut, sum(l * l)::DOUBLE / sum(l) + sum(r * r)::DOUBLE / sum(r) AS purity FROM s GROUP BY cut HAVING sum(r) > 0),
b AS (SELECT cut FROM g ORDER BY purity DESC, cut LIMIT 1),
p AS (SELECT (SELECT event_type FROM s JOIN b USING (cut) ORDER BY l DESC, event_type LIMIT 1) AS lc,
  (SELECT event_type FROM s JOIN b USING (cut) ORDER BY r DESC, event_type LIMIT 1) AS rc)
SELECT event_id, CASE WHEN user_id <= cut THEN lc ELSE rc END AS prediction FROM events, b, p
""")(_forest_clf_stump)


def _boosted_clf_stump(kind):
    """One boosting round of depth 1 on user_id under the logistic loss."""
    def q(spark, sf):
        d = load(spark, sf, "events").select("event_id", "user_id", (F.col("event_type") == "click").cast("int").alias("click"))
        m = models.fit(d, "click", ["user_id"], "classification", kind, rounds=1, depth=1)
        return m.transform(d).select("event_id", (F.round("score", 6) + 0.0).alias("score"))
    return q


def _clf_stump_sql(l2: float, lr: float, least: str) -> str:
    """Gradient and hessian sums per user_id; a leaf is -G / (H + l2)."""
    gain = f"gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2})"
    return f"""
WITH q AS (SELECT avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) AS q FROM events),
v AS (SELECT user_id, count(*) AS n, sum(q - CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS g, sum(q * (1 - q)) AS h FROM events, q GROUP BY user_id),
c AS (SELECT user_id, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER () AS n, sum(g) OVER () AS g, sum(h) OVER () AS h FROM v
  WINDOW w AS (ORDER BY user_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT user_id AS cut, -gl / (hl + {l2}) AS lv, -(g - gl) / (h - hl + {l2}) AS rv FROM c WHERE {least}
  ORDER BY round({gain}, 9) DESC, user_id LIMIT 1)
SELECT event_id, round(1 / (1 + exp(-(ln(q / (1 - q)) + {lr} * CASE WHEN user_id <= cut THEN lv ELSE rv END))), 6) + 0.0 AS score FROM events, b, q
"""


register("E13_hgb_clf_stump", _clf_stump_sql(0.0, 0.1, "nl >= 20 AND n - nl >= 20"))(_boosted_clf_stump("hgb"))
register("E14_xgb_clf_stump", _clf_stump_sql(1.0, 0.3, "hl >= 1 AND h - hl >= 1"))(_boosted_clf_stump("xgb"))


def _softmax_stump(spark, sf):
    """E14 with five classes: one softmax round of depth 1 on user_id, a tree per
    class; the probability of the first class and the likeliest class."""
    d = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    m = models.fit(d, "event_type", ["user_id"], "classification", "xgb", rounds=1, depth=1, lr=1.0)
    p = m.pipeline.transform(d).select("event_id", vector_to_array("probability")[0].alias("p"))
    return m.transform(d).join(p, "event_id").select("event_id", F.col(m.pred_col).alias("prediction"), (F.round("p", 6) + 0.0).alias("p_first"))


register("E14_xgb_clf_multiclass_stump", """
WITH q AS (SELECT event_type AS k, count(*) / (SELECT count(*) FROM events)::DOUBLE AS q FROM events GROUP BY event_type),
v AS (SELECT k, user_id, sum(q - CASE WHEN event_type = k THEN 1 ELSE 0 END) AS g, sum(2 * q * (1 - q)) AS h FROM events, q GROUP BY k, user_id),
c AS (SELECT k, user_id, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER p AS g, sum(h) OVER p AS h FROM v
  WINDOW w AS (PARTITION BY k ORDER BY user_id), p AS (PARTITION BY k)),
b AS (SELECT k, user_id AS cut, -gl / (hl + 1) AS lv, -(g - gl) / (h - hl + 1) AS rv FROM (SELECT *, row_number() OVER (PARTITION BY k
  ORDER BY round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1), 9) DESC, user_id) AS place FROM c WHERE hl >= 1 AND h - hl >= 1) WHERE place = 1),
m AS (SELECT event_id, k, exp(ln(q) + CASE WHEN user_id <= cut THEN lv ELSE rv END) AS e FROM events, b JOIN q USING (k)),
p AS (SELECT event_id, k, e / sum(e) OVER (PARTITION BY event_id) AS p FROM m)
SELECT event_id, arg_max(k, p) AS prediction, round(arg_min(p, k), 6) + 0.0 AS p_first FROM p GROUP BY event_id
""")(_softmax_stump)


def _svr_fit(spark, sf):
    """E8 on a smooth curve of every part: the share of the variance explained."""
    d = load(spark, sf, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("x"))
    d = d.withColumn("y", 10.0 * F.sin("x") + 50.0)
    m = models.fit(d, "y", ["x"], "regression", "svr", "gui")
    p = m.transform(d).select(F.col("y").alias("actual"), F.col(m.pred_col).alias("predicted"), F.lit("all").alias("split"))
    from quarry.operators.evaluate import regression_metrics
    return regression_metrics(p).select((F.col("r2") > 0.99).alias("fits"), "n")


register("E8_svr_smooth_curve", "SELECT true AS fits, count(*) AS n FROM part")(_svr_fit)
def _svr_stationary(spark, sf):
    """At the solution w = C * sum of slope * z over all parts, input by input, and
    the slopes add up to zero (to a millionth of what C times all rows could pull)."""
    d = load(spark, sf, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("x"))
    d = d.withColumn("y", 10.0 * F.sin("x") + 50.0)
    m = models.fit(d, "y", ["x"], "regression", "svr", "gui")
    c, epsilon = float(m.params["C"]), float(m.params["epsilon"])
    r = F.col("y") - F.col("prediction")
    slope = F.signum(r) * F.least(F.greatest(F.abs(r) - epsilon, F.lit(0.0)) / (0.1 * epsilon), F.lit(1.0))
    z = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    pulls = m.pipeline.transform(d).select(F.posexplode(F.transform(z, lambda v: v * slope * c)).alias("i", "pull")) \
        .groupBy("i").agg(F.sum("pull").alias("pull"), F.count(F.lit(1)).alias("n"))
    w = spark.createDataFrame(list(enumerate([*m.pipeline.stages[-1].getOrDefault("coefficients"), 0.0])), "i int, w double")
    return pulls.join(w, "i").agg((F.max(F.abs(F.col("w") - F.col("pull")) / F.col("n")) <= 1e-6 * c).alias("stationary"), F.max("n").alias("n"))


register("E8_svr_stationary", "SELECT true AS stationary, count(*) AS n FROM part")(_svr_stationary)
register("E14_xgb_clf")(_pred_query("classification", "xgb", table="labels"))


def _train_linear(spark, sf, out=None):
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                      "p_retailprice")
    return train_model(d, "p_retailprice", ["p_size"], "regression", "linear", key="p_partkey",
                       seed=42, out_dir=out)


_METRICS_SQL = "WITH " + PART_SPLIT + """,
c AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
  FROM s WHERE split = 'train'),
p AS (SELECT s.split, s.p_retailprice AS actual, c.a + c.b * s.p_size AS predicted FROM s, c)
SELECT split, round(1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)), 6) + 0.0 AS r2,
  round(sqrt(avg((actual - predicted) ^ 2)), 6) + 0.0 AS rmse,
  round(avg(abs(actual - predicted)), 6) + 0.0 AS mae, count(*) AS n
FROM p GROUP BY split
"""

register("F10_train_model", _METRICS_SQL)(lambda spark, sf: rounded(_train_linear(spark, sf).metrics))

register("F9_cross_validate_linear", """
WITH s AS (SELECT p.* FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey::VARCHAR), p_partkey) - 1
  AS pos, count(*) OVER () AS n FROM part) p WHERE pos >= ceil(n * 0.2)),
d AS (SELECT *, ((row_number() OVER (ORDER BY md5('42:' || p_partkey::VARCHAR), p_partkey) - 1) % 5) AS fold FROM s),
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
""")(lambda spark, sf: rounded(_train_linear(spark, sf).cv))


def _scored(spark, sf):
    tr = _part_split(spark, sf).where("split = 'train'")
    m = models.fit(tr, "p_retailprice", ["p_size"], "regression", "linear")
    return m, load(spark, sf, "part")


_PRED_SQL = "WITH " + PART_SPLIT + """,
c AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
  FROM s WHERE split = 'train')"""

register("G1_batch_predict", _PRED_SQL + """
SELECT p.p_partkey, p.p_size, round(c.a + c.b * p.p_size, 4) + 0.0 AS p_retailprice_pred FROM part p, c
""")(lambda spark, sf: (lambda m, d: m.transform(d.select("p_partkey", "p_size"))
                        .withColumn("p_retailprice_pred", F.round("p_retailprice_pred", 4) + 0.0))(*_scored(spark, sf)))


def _score_clean(spark, sf):
    m, _ = _scored(spark, sf)
    # Scoring input: sizes as text (some unparsable), headers in another case.
    raw = load(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_brand") == "Brand#13", F.concat(F.col("p_size").cast("string"), F.lit("x")))
        .otherwise(F.col("p_size").cast("string")).alias("P_SIZE"))
    r = sc.score_clean(m, raw)
    rep = r.report().first()
    return r.predictions.select("p_size", F.round("p_retailprice_pred", 4).alias("p_retailprice_pred")) \
        .withColumn("rows_read", F.lit(rep["rows_read"])).withColumn("rows_used", F.lit(rep["rows_used"]))


register("G2_score_clean", _PRED_SQL + """,
r AS (SELECT p_size, p_brand FROM part)
SELECT p_size::DOUBLE AS p_size, round(c.a + c.b * p_size, 4) + 0.0 AS p_retailprice_pred,
  (SELECT count(*) FROM part) AS rows_read,
  (SELECT count(*) FROM part WHERE p_brand <> 'Brand#13') AS rows_used
FROM r, c WHERE p_brand <> 'Brand#13'
""")(_score_clean)


def _roundtrip_run(spark, sf):
    """Train and save a run, list the runs folder, and read the
    manifest and the test metrics back."""
    root = sinks.scratch_path(spark, "runs")
    _train_linear(spark, sf, out=f"{root}/part_linear")
    listed = runs.list_runs(spark, root)
    return rounded(listed.select("name", "model", "task", "target", F.array_join("features", ",").alias("features"),
                                 "r2", "rmse", "mae", "n"))


register("A9_list_runs", _METRICS_SQL.replace("SELECT split, round(1", "SELECT 'part_linear' AS name, 'linear' AS model, "
                                              "'regression' AS task, 'p_retailprice' AS target, 'p_size' AS features, "
                                              "round(1").replace("FROM p GROUP BY split", "FROM p WHERE split = 'test'"))(
    _roundtrip_run)


def _load_score(spark, sf):
    """Save the fitted pipeline, load it back, score the whole table."""
    m, d = _scored(spark, sf)
    root = sinks.scratch_path(spark, "model")
    runs.save_model(m, root)
    runs.save_manifest(spark, root, m, 42)
    back = runs.load_model(spark, root)
    return back.transform(d.select("p_partkey", "p_size")) \
        .withColumn("p_retailprice_pred", F.round("p_retailprice_pred", 4) + 0.0)


register("A7_save_load_model", _PRED_SQL + """
SELECT p.p_partkey, p.p_size, round(c.a + c.b * p.p_size, 4) + 0.0 AS p_retailprice_pred FROM part p, c
""")(_load_score)


def _csv_roundtrip(spark, sf):
    """A1: write a table as CSV with a header, read it back with inferred types."""
    path = sinks.scratch_path(spark, "csv")
    load(spark, sf, "part").write.mode("overwrite").option("header", True).csv(path)
    back = read_table(spark, path)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_type",
                       F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


register("A1_read_table_csv", "SELECT * FROM part")(_csv_roundtrip)


def _scores_roundtrip(spark, sf):
    """A3 + A10: write long scores partitioned by metric, read the per-metric
    tables back and merge them on feature."""
    from quarry.plans.queries_assoc import _li_scores
    long = _li_scores(spark, sf)
    path = sinks.scratch_path(spark, "scores")
    sinks.write_scores(long, path, layout="per_metric", fmt="parquet")
    back = spark.read.parquet(f"{path}/scores_by_metric")
    tables = {m: back.where(F.col("metric") == m) for m in ("pearson", "spearman")}
    return rounded(runs.combine_scores(tables, ["pearson", "spearman"]))


register("A10_combine_scores", __import__("quarry.plans.catalog", fromlist=["x"]).sql_lineitem_scores() + """
SELECT feature, round(max(score) FILTER (WHERE metric = 'pearson'), 6) + 0.0 AS pearson,
  round(max(score) FILTER (WHERE metric = 'spearman'), 6) + 0.0 AS spearman
FROM s GROUP BY feature
""")(_scores_roundtrip)


# ------------------------------------------------------------------ A4, A5, A8
def _parity_roundtrip(spark, sf):
    r = _train_linear(spark, sf)
    path = sinks.scratch_path(spark, "parity")
    sinks.write_parity(r.parity, path)
    back = spark.read.parquet(f"{path}/parity")
    return back.select("split", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))


register("A4_write_parity", _PRED_SQL + """
SELECT s.split, round(s.p_retailprice, 4) AS actual, round(c.a + c.b * s.p_size, 4) AS predicted FROM s, c
""")(_parity_roundtrip)


def _metrics_roundtrip(spark, sf):
    r = _train_linear(spark, sf)
    path = sinks.scratch_path(spark, "metrics")
    sinks.write_metrics(r.metrics, path)
    back = spark.read.json(f"{path}/metrics")
    return rounded(back.select("split", "r2", "rmse", "mae", "n"))


register("A5_write_metrics", _METRICS_SQL)(_metrics_roundtrip)


def _parity_all(spark, sf):
    """A4: the union of both splits."""
    path = sinks.scratch_path(spark, "parity")
    sinks.write_parity(_train_linear(spark, sf).parity, path)
    return spark.read.parquet(f"{path}/parity_all").select(
        "split", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))


register("A4_write_parity_all", _PRED_SQL + """
SELECT s.split, round(s.p_retailprice, 4) AS actual, round(c.a + c.b * s.p_size, 4) AS predicted FROM s, c
""")(_parity_all)


def _scores_layout(layout, fmt):
    """A3: the scores written in one layout and format, and read back."""
    def q(spark, sf):
        from quarry.operators.assoc import wide_table
        from quarry.plans.queries_assoc import _li_scores
        long = _li_scores(spark, sf)
        path = sinks.scratch_path(spark, "scores")
        if layout == "long":
            sinks.write_scores(long, path, "long", fmt)
            return rounded(read_table(spark, f"{path}/scores_long", fmt).select("metric", "feature", F.col("score").cast("double")))
        sinks.write_scores(wide_table(long, ["pearson", "spearman"]), path, "wide", fmt)
        back = read_table(spark, f"{path}/scores_wide", fmt)
        return rounded(back.select("feature", F.col("pearson").cast("double"), F.col("spearman").cast("double")))
    return q


_SCORES_SQL = __import__("quarry.plans.catalog", fromlist=["x"]).sql_lineitem_scores()
_LONG_SQL = _SCORES_SQL + " SELECT metric, feature, round(score, 6) + 0.0 AS score FROM s"
_WIDE_SQL = _SCORES_SQL + """ SELECT feature, round(max(score) FILTER (WHERE metric = 'pearson'), 6) + 0.0 AS pearson,
  round(max(score) FILTER (WHERE metric = 'spearman'), 6) + 0.0 AS spearman FROM s GROUP BY feature"""
register("A3_write_scores_long_csv", _LONG_SQL)(_scores_layout("long", "csv"))
register("A3_write_scores_wide_json", _WIDE_SQL)(_scores_layout("wide", "json"))


def _listed_broken(spark, sf):
    """A good run, one without manifest, one with a broken manifest, and an
    empty root."""
    root = sinks.scratch_path(spark, "runs")
    _train_linear(spark, sf, out=f"{root}/good")
    metrics = spark.read.json(f"{root}/good/metrics")
    sinks.write_metrics(metrics, f"{root}/no_manifest")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{root}/torn/manifest")
    none = runs.list_runs(spark, f"{root}/nothing-here").select("name", "model")
    listed = runs.list_runs(spark, root)
    return rounded(listed.select("name", "model", "r2")).unionByName(none.withColumn("r2", F.lit(None).cast("double")))


register("A9_list_runs_broken", _METRICS_SQL.replace("SELECT split, round(1", "SELECT g.name, g.model, CASE WHEN g.name <> 'torn' THEN m.r2 END AS r2 FROM (SELECT split, round(1") + """) m,
(VALUES ('good', 'linear'), ('no_manifest', NULL), ('torn', NULL)) g(name, model) WHERE m.split = 'test'
""")(_listed_broken)


def _score_from_run(spark, sf):
    """G2 from a run folder: the saved model on the table its manifest names."""
    from quarry.plans.score import score_run
    root = sinks.scratch_path(spark, "run")
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    train_model(d, "p_retailprice", ["p_size"], "regression", "linear", key="p_partkey", seed=42, cv=False, out_dir=root,
                data_path=f"{sf.rstrip('/')}/part.parquet")
    r = score_run(spark, root, out=f"{root}/scored")
    back = spark.read.parquet(f"{root}/scored/predictions")
    return back.select("p_size", F.round("p_retailprice_pred", 4).alias("p_retailprice_pred"), F.lit(r.rows_used).alias("rows_used"))


register("G2_from_run", _PRED_SQL + """
SELECT p.p_size::DOUBLE AS p_size, round(c.a + c.b * p.p_size, 4) AS p_retailprice_pred, (SELECT count(*) FROM part) AS rows_used FROM part p, c
""")(_score_from_run)


def _parity_from_run(spark, sf):
    """F6 of a saved run whose parity table is missing."""
    root = sinks.scratch_path(spark, "run")
    m, _ = _scored(spark, sf)
    runs.save_model(m, root)
    runs.save_manifest(spark, root, m, 42, f"{sf.rstrip('/')}/part.parquet")
    p = runs.parity_of(spark, root, "p_partkey")
    return p.select("split", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))


register("F6_parity_from_run", _PRED_SQL + """
SELECT s.split, round(s.p_retailprice, 4) AS actual, round(c.a + c.b * s.p_size, 4) AS predicted FROM s, c
""")(_parity_from_run)


def _pred_roundtrip(spark, sf):
    m, d = _scored(spark, sf)
    path = sinks.scratch_path(spark, "pred")
    pred = m.transform(d.select("p_partkey", "p_size"))
    sinks.write_predictions(pred, path, run_id="run1")
    back = spark.read.parquet(path)
    return back.select("p_partkey", F.round("p_retailprice_pred", 4).alias("p_retailprice_pred"), "run_id")


register("A8_write_predictions", _PRED_SQL + """
SELECT p.p_partkey, round(c.a + c.b * p.p_size, 4) AS p_retailprice_pred, 'run1' AS run_id FROM part p, c
""")(_pred_roundtrip)


def _two_runs(spark, sf):
    """Two scoring runs in one table, the first of them written twice."""
    m, d = _scored(spark, sf)
    path = sinks.scratch_path(spark, "pred")
    pred = m.transform(d.select("p_partkey", "p_size"))
    sinks.write_predictions(pred.where("p_partkey % 2 = 0"), path, run_id="run1")
    sinks.write_predictions(pred, path, run_id="run2")
    sinks.write_predictions(pred.where("p_partkey % 3 = 0"), path, run_id="run1")
    back = spark.read.parquet(path)
    return back.select("p_partkey", F.round("p_retailprice_pred", 4).alias("p_retailprice_pred"), "run_id")


register("A8_write_predictions_two_runs", _PRED_SQL + """
SELECT p.p_partkey, round(c.a + c.b * p.p_size, 4) AS p_retailprice_pred, r.run_id FROM part p, c, (VALUES ('run1'), ('run2')) r(run_id)
WHERE r.run_id = 'run2' OR p.p_partkey % 3 = 0
""")(_two_runs)


def _parity_other_split(spark, sf):
    """F6 of a run trained on 60 % of the rows, from its manifest."""
    root = sinks.scratch_path(spark, "run")
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    s = split.split_random(d, 0.4, 42, "p_partkey")
    m = models.fit(s.where("split = 'train'"), "p_retailprice", ["p_size"], "regression", "linear")
    runs.save_model(m, root)
    runs.save_manifest(spark, root, m, 42, f"{sf.rstrip('/')}/part.parquet", {"method": "random", "test_size": 0.4, "key": "p_partkey"})
    p = runs.parity_of(spark, root)
    return p.select("split", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))


register("F6_parity_from_run_other_split", _PRED_SQL.replace("0.2", "0.4") + """
SELECT s.split, round(s.p_retailprice, 4) AS actual, round(c.a + c.b * s.p_size, 4) AS predicted FROM s, c
""")(_parity_other_split)


# ------------------------------------------------------------------ B8, B11, B12
def _feature_spec(spark, sf):
    from quarry.operators.prep import feature_spec
    li = load(spark, sf, "lineitem")
    inputs, target, _ = feature_spec(li.columns, "auto_inputs")
    inputs, target, _ = feature_spec(li.columns, "set_target_direct", inputs, "l_extendedprice")
    inputs, target, sel = feature_spec(li.columns, "remove_inputs", inputs, target,
                                       selected=["l_shipdate", "l_returnflag", "l_linestatus"])
    return li.select(*inputs, target)


register("B8_feature_spec", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem
""")(_feature_spec)


def _align(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from quarry.operators.models import fit_encoder
    cu = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    enc = fit_encoder(cu.where(F.col("c_mktsegment") != "MACHINERY"), ["c_mktsegment"])
    arr = vector_to_array(F.col("features"))
    return enc.transform(cu).select("c_custkey", (F.array_position(arr, 1.0) - 1).cast("long").alias("slot"),
                                    F.size(arr).alias("width"))


register("B11_align_to_features", """
WITH k AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS r
  FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'))
SELECT c.c_custkey, coalesce(k.r, -1)::BIGINT AS slot, (SELECT count(*) FROM k)::INTEGER AS width
FROM customer c LEFT JOIN k USING (c_mktsegment)
""")(_align)


def _union_features(spark, sf):
    tr = _part_split(spark, sf).where("split = 'train'")
    m = models.fit(tr, "p_retailprice", ["p_size", "p_type"], "regression", "linear")
    names = m.feature_names()
    return spark.createDataFrame(list(enumerate(names)), "slot long, feature string")


register("B12_union_features", "WITH " + PART_SPLIT + """
SELECT 0::BIGINT AS slot, 'p_size' AS feature
UNION ALL SELECT row_number() OVER (ORDER BY p_type), 'p_type=' || p_type
FROM (SELECT DISTINCT p_type FROM s WHERE split = 'train')
""")(_union_features)


# ------------------------------------------------------------------ E9, E15
_EV_SPLIT = """s AS (SELECT e.*, epoch_us(ts) / 1e6 AS ts_s,
  CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS pos,
  count(*) OVER () AS n FROM events) e)"""


def _knn_sql(x1: str, x2: str, label: str, out: str) -> str:
    return "WITH " + _EV_SPLIT + f""",
tr AS (SELECT event_id AS rid, {label} AS label, {x1}::DOUBLE AS a, {x2}::DOUBLE AS b FROM s WHERE split = 'train'),
st AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM tr),
te AS (SELECT event_id AS qid, {x1}::DOUBLE AS a, {x2}::DOUBLE AS b FROM s WHERE split = 'test'),
pr AS (SELECT te.qid, tr.rid, tr.label, sqrt(((te.a - st.ma) / st.sa - (tr.a - st.ma) / st.sa) ^ 2
  + ((te.b - st.mb) / st.sb - (tr.b - st.mb) / st.sb) ^ 2) AS d FROM te, tr, st),
nn AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS r FROM pr)
"""


def _events_ts(spark, sf):
    ev = load(spark, sf, "events")
    ev = ev.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return split.split_random(ev, 0.2, 42, "event_id")


def _knn_reg(spark, sf):
    s = _events_ts(spark, sf)
    m = models.fit(s.where("split = 'train'"), "value", ["ts_s", "user_id"], "regression", "knn", key="event_id")
    return rounded(m.transform(s.where("split = 'test'").select("event_id", "ts_s", "user_id"))
                   .select("event_id", "value_pred"))


register("E9_knn", _knn_sql("ts_s", "user_id", "value", "value_pred") + """
SELECT qid AS event_id, round(avg(label), 6) + 0.0 AS value_pred FROM nn WHERE r <= 5 GROUP BY qid
""")(_knn_reg)


def _train_knn(spark, sf):
    """F10 with a neighbour model: split, fit, evaluate both splits."""
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                      (F.col("p_partkey") + 0.3 * F.sin("p_partkey")).alias("k"), "p_retailprice")
    return rounded(train_model(d, "p_retailprice", ["p_size", "k"], "regression", "knn", key="p_partkey", seed=42, cv=False).metrics)


register("F10_train_knn", "WITH " + PART_SPLIT + """,
x AS (SELECT *, p_partkey + 0.3::DOUBLE * sin(p_partkey) AS k FROM s),
tr AS (SELECT p_partkey AS rid, p_retailprice AS label, p_size::DOUBLE AS a, k AS b FROM x WHERE split = 'train'),
st AS (SELECT stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM tr),
pr AS (SELECT s.p_partkey, s.split, s.p_retailprice AS actual, tr.label,
  row_number() OVER (PARTITION BY s.p_partkey ORDER BY ((s.p_size - tr.a) / sa) ^ 2 + ((s.k - tr.b) / sb) ^ 2, rid) AS r
  FROM x s, tr, st),
p AS (SELECT p_partkey, split, actual, avg(label) AS predicted FROM pr WHERE r <= 5 GROUP BY ALL)
SELECT split, round(1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)), 6) + 0.0 AS r2,
  round(sqrt(avg((actual - predicted) ^ 2)), 6) + 0.0 AS rmse,
  round(avg(abs(actual - predicted)), 6) + 0.0 AS mae, count(*) AS n FROM p GROUP BY split
""")(_train_knn)


def _knn_many(spark, sf):
    """E9 with five numeric inputs and a categorical one."""
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_partkey").cast("double").alias("b"),
                                      F.sin("p_partkey").alias("c"), F.cos(F.col("p_partkey") * 2.0).alias("d"),
                                      (F.col("p_partkey") % 97).cast("double").alias("e"), "p_type", "p_retailprice")
    s = split.split_random(d, 0.2, 42, "p_partkey")
    m = models.fit(s.where("split = 'train'"), "p_retailprice", ["a", "b", "c", "d", "e", "p_type"], "regression", "knn", key="p_partkey")
    return rounded(m.transform(s.where("split = 'test'")).select("p_partkey", "p_retailprice_pred"))


register("E9_knn_many_inputs", "WITH " + PART_SPLIT + """,
x AS (SELECT *, p_size::DOUBLE AS a, p_partkey::DOUBLE AS b, sin(p_partkey) AS c, cos(p_partkey * 2.0::DOUBLE) AS d, (p_partkey % 97)::DOUBLE AS e FROM s),
tr AS (SELECT * FROM x WHERE split = 'train'),
st AS (SELECT stddev_samp(a) AS sa, stddev_samp(b) AS sb, stddev_samp(c) AS sc, stddev_samp(d) AS sd, stddev_samp(e) AS se FROM tr),
ty AS (SELECT k.p_type, 1 / var_samp((tr.p_type = k.p_type)::INTEGER) AS w FROM tr, (SELECT DISTINCT p_type FROM tr) k GROUP BY k.p_type),
pr AS (SELECT q.p_partkey, tr.p_retailprice AS label, row_number() OVER (PARTITION BY q.p_partkey ORDER BY
  ((q.a - tr.a) / sa) ^ 2 + ((q.b - tr.b) / sb) ^ 2 + ((q.c - tr.c) / sc) ^ 2 + ((q.d - tr.d) / sd) ^ 2 + ((q.e - tr.e) / se) ^ 2
  + CASE WHEN q.p_type = tr.p_type THEN 0 ELSE coalesce(tq.w, 0) + tt.w END, tr.p_partkey) AS r
  FROM x q JOIN tr ON q.split = 'test' JOIN ty tt ON tt.p_type = tr.p_type LEFT JOIN ty tq ON tq.p_type = q.p_type, st)
SELECT p_partkey, round(avg(label), 6) + 0.0 AS p_retailprice_pred FROM pr WHERE r <= 5 GROUP BY p_partkey
""")(_knn_many)


def _knn_clf(spark, sf):
    s = _events_ts(spark, sf)
    m = models.fit(s.where("split = 'train'"), "event_type", ["value", "ts_s"], "classification", "knn",
                   key="event_id")
    return m.transform(s.where("split = 'test'").select("event_id", "value", "ts_s")) \
        .select("event_id", "event_type_pred")


register("E15_knn_clf", _knn_sql("value", "ts_s", "event_type", "event_type_pred") + """,
v AS (SELECT qid, label, count(*) AS c FROM nn WHERE r <= 5 GROUP BY ALL)
SELECT qid AS event_id, label AS event_type_pred FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS rr FROM v) WHERE rr = 1
""")(_knn_clf)
