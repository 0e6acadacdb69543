"""Registered queries for explanation (H), tuning (I1) and streaming scoring.

They use an order-level table that Spark derives from ``lineitem`` (lines,
quantity, discount and price per order), whose price total has a real
dependence on the line count.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import models, split
from quarry.operators.explain import permutation_importance, top_importance
from quarry.plans.catalog import load, register, rounded
from quarry.session import cut_lineage
from quarry.sources import sinks

ORDER_FEATS_SQL = """of AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
  avg(l_discount) AS avg_disc, sum(l_extendedprice) AS sum_price FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o.*, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || l_orderkey::VARCHAR), l_orderkey) - 1 AS pos,
  count(*) OVER () AS n FROM of) o),
c AS (SELECT regr_slope(sum_price, n_lines) AS b, regr_intercept(sum_price, n_lines) AS a FROM s WHERE split = 'train')"""


def order_features(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
                                        F.avg("l_discount").alias("avg_disc"),
                                        F.sum("l_extendedprice").alias("sum_price"))


def _fit_orders(spark, sf, kind="linear", inputs=("n_lines",), **params):
    # read by many jobs: the split, the fit and what explains it
    of = split.split_random(cut_lineage(order_features(spark, sf)), 0.2, 42, "l_orderkey")
    m = models.fit(of.where("split = 'train'"), "sum_price", list(inputs), "regression", kind, **params)
    return m, of.drop("split")


def _perm(spark, sf):
    m, data = _fit_orders(spark, sf)
    return rounded(permutation_importance(m, data, "l_orderkey", 10, 42))


_H2_SQL = "WITH " + ORDER_FEATS_SQL + """,
b AS (SELECT *, row_number() OVER (ORDER BY md5('42:base:' || l_orderkey::VARCHAR), l_orderkey) - 1 AS pos0 FROM of),
ex AS (SELECT b.*, r.range AS rep FROM b, range(10) r),
dn AS (SELECT rep, n_lines AS dn, row_number() OVER (PARTITION BY rep
  ORDER BY md5('42:' || l_orderkey::VARCHAR || ':' || rep::VARCHAR), l_orderkey) - 1 AS pos0 FROM ex),
pj AS (SELECT ex.rep, ex.sum_price AS actual, c.a + c.b * dn.dn AS predicted FROM ex JOIN dn USING (rep, pos0), c),
m AS (SELECT rep, 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) AS r2 FROM pj GROUP BY rep),
base AS (SELECT 1 - sum((sum_price - (c.a + c.b * n_lines)) ^ 2) / (var_pop(sum_price) * count(*)) AS r2b FROM of, c)
SELECT 'n_lines' AS feature, round(avg(r2b - r2), 6) + 0.0 AS importance,
  round(stddev_pop(r2b - r2), 6) + 0.0 AS importance_std, round(max(r2b), 6) + 0.0 AS baseline FROM m, base
"""
register("H2_permutation_importance", _H2_SQL)(_perm)


def _perm_multi(spark, sf):
    m, data = _fit_orders(spark, sf, "ridge", ("n_lines", "sum_qty", "avg_disc"))
    return top_importance(permutation_importance(m, data, "l_orderkey", 10, 42), 2).select("feature")


register("H3_top_importance")(_perm_multi)


def _perm_pair(spark, sf):
    """H3 of a line on two inputs: the more important one."""
    m, data = _fit_orders(spark, sf, "linear", ("n_lines", "avg_disc"))
    return rounded(top_importance(permutation_importance(m, data, "l_orderkey", 10, 42), 1).select("feature", "importance", "baseline"))


register("H3_top_importance_pair", "WITH " + ORDER_FEATS_SQL + """,
t AS (SELECT avg(n_lines) AS m1, avg(avg_disc) AS m2, avg(sum_price) AS my, var_pop(n_lines) AS v11, var_pop(avg_disc) AS v22,
  covar_pop(n_lines, avg_disc) AS v12, covar_pop(n_lines, sum_price) AS c1, covar_pop(avg_disc, sum_price) AS c2 FROM s WHERE split = 'train'),
k AS (SELECT (v22 * c1 - v12 * c2) / (v11 * v22 - v12 * v12) AS b1, (v11 * c2 - v12 * c1) / (v11 * v22 - v12 * v12) AS b2, m1, m2, my FROM t),
b AS (SELECT *, row_number() OVER (ORDER BY md5('42:base:' || l_orderkey::VARCHAR), l_orderkey) - 1 AS pos0 FROM of),
ex AS (SELECT b.*, r.range AS rep FROM b, range(10) r),
dn AS (SELECT rep, n_lines AS d1, avg_disc AS d2, row_number() OVER (PARTITION BY rep
  ORDER BY md5('42:' || l_orderkey::VARCHAR || ':' || rep::VARCHAR), l_orderkey) - 1 AS pos0 FROM ex),
pj AS (SELECT f.feature, ex.rep, ex.sum_price AS actual,
  my + b1 * (CASE WHEN f.feature = 'n_lines' THEN d1 ELSE n_lines END - m1) + b2 * (CASE WHEN f.feature = 'avg_disc' THEN d2 ELSE avg_disc END - m2) AS predicted
  FROM ex JOIN dn USING (rep, pos0), k, (VALUES ('n_lines'), ('avg_disc')) f(feature)),
m AS (SELECT feature, rep, 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) AS r2 FROM pj GROUP BY ALL),
base AS (SELECT 1 - sum((sum_price - my - b1 * (n_lines - m1) - b2 * (avg_disc - m2)) ^ 2) / (var_pop(sum_price) * count(*)) AS r2b FROM of, k)
SELECT feature, round(avg(r2b - r2), 6) + 0.0 AS importance, round(max(r2b), 6) + 0.0 AS baseline FROM m, base
GROUP BY feature ORDER BY avg(r2b - r2) DESC, feature LIMIT 1
""")(_perm_pair)


def _shap(spark, sf):
    from quarry.operators.shap import shap_importance
    m, data = _fit_orders(spark, sf, "hgb", ("n_lines", "sum_qty", "avg_disc"))
    return shap_importance(m, data)


register("H1_shap_importance")(_shap)


def _explain_job(spark, sf):
    from quarry.plans.explain_job import explain
    m, data = _fit_orders(spark, sf, "hgb", ("n_lines", "sum_qty", "avg_disc"))
    imp, rep = explain(spark, m, data, "l_orderkey")
    r = rep.first()
    return imp.withColumn("method", F.lit(r["method"])).withColumn("n_samples", F.lit(r["n_samples"]))


register("H4_explain_run")(_explain_job)


def _shap_adds_up(spark, sf):
    """H1: per row, the values of all inputs and the base add up to the model's
    prediction; emitted: rows for which they do not (none), and all rows."""
    from quarry.operators.shap import shap_gaps
    m, data = _fit_orders(spark, sf, "hgb", ("n_lines", "sum_qty", "avg_disc"))
    return shap_gaps(m, data, 1e-6)


register("H1_shap_additivity", """
SELECT 0::BIGINT AS rows_off, count(DISTINCT l_orderkey) AS n FROM lineitem
""")(_shap_adds_up)


def _part_forest(spark, sf):
    """A forest at the profile's size on the whole table of parts."""
    d = load(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return models.fit(d, "p_retailprice", ["p_size", "p_brand"], "regression", "rf"), d


def _forest_adds_up(spark, sf):
    """H1 as above, of a forest, on every part."""
    from quarry.operators.shap import shap_gaps
    m, data = _part_forest(spark, sf)
    return shap_gaps(m, data, 1e-6)


register("H1_shap_additivity_forest", """
SELECT 0::BIGINT AS rows_off, count(*) AS n FROM part
""")(_forest_adds_up)


def _explain_forest(spark, sf):
    """H4 of that forest on its sample of 500 rows."""
    from quarry.plans.explain_job import explain
    m, data = _part_forest(spark, sf)
    imp, rep = explain(spark, m, data, "p_partkey", max_samples=500)
    r = rep.first()
    return imp.withColumn("method", F.lit(r["method"])).withColumn("n_samples", F.lit(r["n_samples"]))


register("H4_explain_forest")(_explain_forest)


def _explain_from_run(spark, sf):
    """H4 from a run folder: permutation importance of a saved line on the table
    that its manifest names."""
    from quarry.plans.explain_job import explain_run
    from quarry.sources import runs
    root = sinks.scratch_path(spark, "run")
    m, data = _fit_orders(spark, sf)
    data.write.parquet(f"{root}/data.parquet")
    runs.save_model(m, root)
    runs.save_manifest(spark, root, m, 42, f"{root}/data.parquet")
    explain_run(spark, root, "l_orderkey", out=f"{root}/explained")
    back = spark.read.json(f"{root}/explained/importance")
    n = spark.read.json(f"{root}/explained/report").first()
    return rounded(back.select("feature", "importance", "importance_std", "baseline")).withColumn("n_samples", F.lit(n["n_samples"]))


register("H4_from_run", "SELECT *, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_samples FROM (" + _H2_SQL + ")")(_explain_from_run)


def _tune(spark, sf):
    """The thirty draws of the quick budget."""
    from quarry.operators.tune import tune
    of = order_features(spark, sf).select("l_orderkey", F.col("n_lines").cast("double").alias("n_lines"), "sum_price")
    _, table = tune(of, "sum_price", ["n_lines"], "regression", "ridge", "l_orderkey", mode="quick")
    return rounded(table.select("draw", "params", "r2_mean"))


def _tune_sql() -> str:
    from quarry.operators.tune import draws
    alphas = ", ".join(f"({i}, {p['alpha']!r}::DOUBLE, '{str(sorted(p.items())).replace(chr(39), chr(39) * 2)}')"
                       for i, p in enumerate(draws("ridge", 30, 42)))
    return f"""WITH {ORDER_FEATS_SQL},
a(draw, alpha, params) AS (VALUES {alphas}),
d AS (SELECT l_orderkey, n_lines::DOUBLE AS x, sum_price AS y,
  (row_number() OVER (ORDER BY md5('42:' || l_orderkey::VARCHAR)) - 1) % 5 AS fold FROM of),
f AS (SELECT range AS fold FROM range(5)),
t AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
  FROM f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
p AS (SELECT a.draw, a.params, d.fold, d.y, my + sxy / (sxx + alpha) * (d.x - mx) AS yp FROM d JOIN t USING (fold), a),
m AS (SELECT draw, params, fold, 1 - sum((y - yp) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY ALL)
SELECT draw::INTEGER AS draw, params, round(avg(r2), 6) + 0.0 AS r2_mean FROM m GROUP BY draw, params"""


register("I1_tune_ridge", _tune_sql())(_tune)


def _tune_two(spark, sf):
    """I1 with two inputs."""
    from quarry.operators.tune import tune
    of = order_features(spark, sf).select("l_orderkey", F.col("n_lines").cast("double").alias("n_lines"), "sum_qty", "sum_price")
    _, table = tune(of, "sum_price", ["n_lines", "sum_qty"], "regression", "ridge", "l_orderkey", mode="quick")
    return rounded(table.select("draw", "params", "r2_mean"))


def _tune_two_sql() -> str:
    """Two normal equations per fold and penalty, solved by Cramer's rule."""
    head = _tune_sql().split("d AS (SELECT")[0]
    cov = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
    return head + f"""d AS (SELECT l_orderkey, n_lines::DOUBLE AS u, sum_qty::DOUBLE AS v, sum_price AS y,
  (row_number() OVER (ORDER BY md5('42:' || l_orderkey::VARCHAR)) - 1) % 5 AS fold FROM of),
f AS (SELECT range AS fold FROM range(5)),
t AS (SELECT f.fold, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, {cov('u', 'u')} AS uu, {cov('v', 'v')} AS vv, {cov('u', 'v')} AS uv,
  {cov('u', 'y')} AS uy, {cov('v', 'y')} AS vy FROM f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
b AS (SELECT fold, draw, params, mu, mv, my, (uy * (vv + alpha) - vy * uv) / ((uu + alpha) * (vv + alpha) - uv * uv) AS b1,
  (vy * (uu + alpha) - uy * uv) / ((uu + alpha) * (vv + alpha) - uv * uv) AS b2 FROM t, a),
m AS (SELECT draw, params, fold, 1 - sum((y - my - b1 * (u - mu) - b2 * (v - mv)) ^ 2) / (var_pop(y) * count(*)) AS r2
  FROM d JOIN b USING (fold) GROUP BY ALL)
SELECT draw::INTEGER AS draw, params, round(avg(r2), 6) + 0.0 AS r2_mean FROM m GROUP BY draw, params"""


register("I1_tune_ridge_two_inputs", _tune_two_sql())(_tune_two)


def _tune_density(spark, sf):
    """I1 by densities: the budget is spent, the first sets are the random ones, and
    the best of all is no worse than the best of as many random draws."""
    from quarry.operators.tune import STARTUP, draws, tune
    d = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
                                       F.col("p_brand"), F.col("p_type"))
    args = (d, "p_retailprice", ["p_size", "p_brand", "p_type"], "regression", "ridge", "p_partkey")
    _, found = tune(*args, mode="optuna", refit=False)
    _, plain = tune(*args, mode="intense", trials=100, refit=False)
    first = spark.createDataFrame([(i, str(sorted(p.items()))) for i, p in enumerate(draws("ridge", STARTUP, 42))], "draw int, params string")
    marked = found.join(F.broadcast(first.withColumn("random", F.lit(1))), ["draw", "params"], "left").withColumn("by", F.lit("density")) \
        .unionByName(plain.withColumn("by", F.lit("random")), allowMissingColumns=True)
    here = F.col("by") == "density"
    return marked.agg(F.count_if(here).alias("sets"), F.count("random").alias("random_sets"),
                      (F.max(F.when(here, F.col("r2_mean"))) >= F.max(F.when(~here, F.col("r2_mean"))) - 1e-6).alias("no_worse"))


register("I1_tune_density")(_tune_density)


def _stream(spark, sf):
    """Score the order table as a stream: files in a folder -> fitted
    pipeline -> parquet sink (availableNow), then read the sink."""
    m, data = _fit_orders(spark, sf)
    src = sinks.scratch_path(spark, "stream-src")
    data.select("l_orderkey", F.col("n_lines").cast("double").alias("n_lines")).repartition(4) \
        .write.mode("overwrite").parquet(src)
    from quarry.streaming.score_stream import score_stream
    sink, ck = sinks.scratch_path(spark, "stream-out"), sinks.scratch_path(spark, "stream-ck")
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("n_lines", T.DoubleType())])
    score_stream(spark, m, src, schema, sink, ck)
    return spark.read.parquet(sink).select("l_orderkey", F.round("sum_price_pred", 4).alias("sum_price_pred"))


register("G1_stream_score", "WITH " + ORDER_FEATS_SQL + """
SELECT l_orderkey, round(c.a + c.b * n_lines, 4) AS sum_price_pred FROM of, c
""")(_stream)
