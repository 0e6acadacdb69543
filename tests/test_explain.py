import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import models, shap
from quarry.operators.explain import permutation_importance, top_importance
from quarry.plans.queries_explain import order_features


@pytest.fixture(scope="module")
def orders_feats(spark):
    return order_features(spark, "/root/testdata/sf0.001").persist()


def _follow(nodes, x, known, at=0):
    """Expected value of a tree when only the inputs in ``known`` are known."""
    n = nodes[at]
    if n["left"] is None or n["left"] < 0:
        return np.array(n["value"])
    low, high = nodes[n["left"]], nodes[n["right"]]
    if n["feature"] in known:
        to_low = (x[n["feature"]] <= n["threshold"]) != n["flip"]
        return _follow(nodes, x, known, n["left"] if to_low else n["right"])
    return (low["cover"] * _follow(nodes, x, known, n["left"]) + high["cover"] * _follow(nodes, x, known, n["right"])) / n["cover"]


def _shapley(trees, x, m):
    """Shapley values of one row by all subsets of inputs."""
    phi = 0
    for nodes in trees:
        worth = {s: _follow(nodes, x, s) for k in range(m + 1) for s in itertools.combinations(range(m), k)}
        parts = []
        for i in range(m):
            rest = [j for j in range(m) if j != i]
            parts.append(sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m)
                             * (worth[tuple(sorted((*s, i)))] - worth[s]) for k in range(m) for s in itertools.combinations(rest, k)))
        phi = phi + np.array(parts)
    return phi


MODELS = [("r", "hgb", "sum_price", {"rounds": 4}), ("r", "rf", "sum_price", {"trees": 3, "max_depth": 6}),
          ("c", "rf", "busy", {"trees": 3, "max_depth": 5}), ("c", "xgb", "size", {"rounds": 2, "depth": 3})]


@pytest.fixture(scope="module")
def mixed(orders_feats):
    """A numeric table with a category and two class targets."""
    return orders_feats.withColumn("kind", F.concat(F.lit("k"), (F.col("l_orderkey") % 3).cast("string"))) \
        .withColumn("busy", F.when(F.col("n_lines") > 3, "yes").otherwise("no")) \
        .withColumn("size", F.when(F.col("sum_qty") < 50, "s").when(F.col("sum_qty") < 120, "m").otherwise("l")).persist()


@pytest.mark.parametrize("task,kind,target,params", MODELS)
def test_shap_is_the_shapley_value_and_adds_up(spark, mixed, task, kind, target, params):
    model = models.fit(mixed, target, ["sum_qty", "avg_disc", "kind"], task, kind, **params)
    m = len(model.feature_names())
    x = np.stack(shap.feature_frame(model, mixed).orderBy("x").toPandas()["x"].to_numpy())[::97]
    nodes, out = shap.tree_nodes(spark, model)
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    blocks = [shap.unpacked(r, out) for r in shap.path_blocks(nodes).collect()]
    got = sum(shap.path_values(x, *b) for b in blocks)
    want = np.stack([_shapley(trees.values(), row, m) for row in x])
    assert got.shape == (len(x), m, out) and np.allclose(got, want, rtol=1e-9, atol=1e-9 * max(1, np.abs(want).max()))
    assert shap.shap_gaps(model, mixed, 1e-6).first() == (0, mixed.count())
    # importance: mean |phi| over rows and outputs, however the rows and the paths are dealt out
    every = np.stack(shap.feature_frame(model, mixed).toPandas()["x"].to_numpy())
    want = dict(zip(model.feature_names(), np.abs(sum(shap.path_values(every, *b) for b in blocks)).mean(axis=(0, 2)), strict=True))
    for parts in (1, 64):
        found = {r["feature"]: r["importance"] for r in shap.shap_importance(model, mixed.repartition(parts)).collect()}
        assert found.keys() == want.keys() and all(abs(found[f] - want[f]) <= 1e-9 * max(1, want[f]) for f in want)


def test_shap_over_many_path_and_row_blocks(spark, mixed, monkeypatch):
    model = models.fit(mixed, "sum_price", ["sum_qty", "avg_disc"], "r", "rf", trees=4, max_depth=6)
    whole = {r[0]: r[1] for r in shap.shap_importance(model, mixed).collect()}
    monkeypatch.setattr(shap, "BLOCK_PATHS", 16)
    monkeypatch.setattr(shap, "GROUP_BYTES", 2**16)
    nodes, _ = shap.tree_nodes(spark, model)
    assert shap.path_blocks(nodes).count() > 5
    cut = {r[0]: r[1] for r in shap.shap_importance(model, mixed).collect()}
    assert whole.keys() == cut.keys() and all(abs(whole[f] - cut[f]) < 1e-9 * whole[f] for f in whole)


def test_shap_of_one_leaf_and_of_no_rows(spark, mixed):
    flat = mixed.withColumn("y", F.lit(2.5))
    model = models.fit(flat, "y", ["sum_qty", "avg_disc"], "r", "rf", trees=2)
    assert [r["importance"] for r in shap.shap_importance(model, flat).collect()] == [0.0, 0.0]
    assert shap.shap_importance(model, flat.where("false")).count() == 0


def test_shap_of_a_full_forest_adds_up(spark, mixed):
    model = models.fit(mixed, "sum_price", ["n_lines", "sum_qty", "avg_disc"], "r", "rf")
    assert model.params["trees"] == 100
    assert shap.shap_gaps(model, mixed.limit(500), 1e-6).first() == (0, 500)


def test_forest_additivity_reads_every_part(spark, tmp_path):
    """The query counts all rows of a table of more than 500, and every row that is off."""
    from quarry.plans.catalog import ORACLE, QUERIES
    rows = [(i, i % 13, f"b{i % 4}", float(i % 13 * 10 + i % 4 + i % 7)) for i in range(1300)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["H1_shap_additivity_forest"](spark, str(tmp_path)).first() == (0, 1300)
    assert "500" not in ORACLE["H1_shap_additivity_forest"]
    # a wrong prediction is found in each row that has it
    part = spark.read.parquet(f"{tmp_path}/part.parquet")
    model = models.fit(part, "p_retailprice", ["p_size", "p_brand"], "r", "rf", trees=3)
    nodes, out = shap.tree_nodes(spark, model)
    x = model.pipeline.transform(part).select(vector_to_array("features").alias("x"), "p_partkey",
                                              (F.col("prediction") + F.when(F.col("p_partkey") % 100 == 7, 1.0).otherwise(0.0)).alias("y"))

    def finish(phi, base, y, times):
        gap = np.abs((phi.sum(axis=1) + base)[:, 0] - y)
        return pd.DataFrame({"off": [int(times[gap > 1e-6].sum())], "rows": [len(y)]})

    once = shap._told_apart(x.select("x", "y"), nodes, len(model.feature_names()))
    got = shap._per_block(once, nodes, len(model.feature_names()), out, finish, "off long, rows long").toPandas().sum()
    assert got["off"] == 13 and got["rows"] <= 13 * 4 + 13


def test_permutation_importance_ranks_signal_first(spark, orders_feats):
    noisy = orders_feats.withColumn("noise", F.rand(3))
    m = models.fit(noisy, "sum_price", ["n_lines", "noise"], "r", "linear")
    imp = permutation_importance(m, noisy, "l_orderkey", repeats=3, seed=1)
    top = top_importance(imp, 1).first()
    assert top["feature"] == "n_lines" and top["importance"] > 0.1


def test_unseen_category_is_zero_vector(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 4.0)], "cat string, y double")
    enc = models.fit_encoder(df.where("cat in ('a', 'b')"), ["cat"])
    out = {r["cat"]: list(r["v"]) for r in enc.transform(df).select("cat", vector_to_array("features").alias("v")).collect()}
    assert out["a"] == [1.0, 0.0] and out["b"] == [0.0, 1.0]
    assert out["c"] == [0.0, 0.0] and out[None] == [0.0, 0.0]


def test_stream_scoring_equals_batch(spark, orders_feats, tmp_path):
    from quarry.streaming.score_stream import score_stream
    m = models.fit(orders_feats, "sum_price", ["n_lines"], "r", "linear")
    src = str(tmp_path / "src")
    orders_feats.select("l_orderkey", F.col("n_lines").cast("double").alias("n_lines")).repartition(3) \
        .write.parquet(src)
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("n_lines", T.DoubleType())])
    score_stream(spark, m, src, schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("l_orderkey").toPandas()
    ref = m.transform(spark.read.parquet(src)).orderBy("l_orderkey").toPandas()
    assert np.allclose(got["sum_price_pred"], ref["sum_price_pred"])


def test_tune_picks_from_draws(spark, orders_feats):
    from quarry.operators.tune import tune
    model, table = tune(orders_feats, "sum_price", ["n_lines"], "r", "ridge", "l_orderkey", trials=7, k=2)
    rows = table.orderBy("draw").collect()
    assert len(rows) == 7 and len({r["params"] for r in rows}) == 7
    best = max(rows, key=lambda r: (r["r2_mean"], -r["draw"]))
    assert best["params"] == str([("alpha", model.params["alpha"])])


def test_densities_mostly_beat_random_draws():
    """Three made-up scores, eight seeds each, sixty sets: the best set is at least as
    good as the best random one in most runs."""
    from quarry.operators import tune
    scores = [lambda p: -((p["rounds"] / 180 - 1) ** 2 + (p["lr"] / 0.06 - 1) ** 2 + (p["depth"] / 4 - 1) ** 2),
              lambda p: -abs(math.log(p["lr"] / 0.15)) - abs(p["rounds"] - 100) / 50 + (p["depth"] == 6) * 0.5,
              lambda p: -math.log(p["lr"] / 0.08) ** 2 - ((p["depth"] - 7) / 4) ** 2]
    won = 0
    for score in scores:
        for seed in range(8):
            plain = tune.draws("hgb", 60, seed)
            tried = [(p, score(p)) for p in plain[:tune.STARTUP]]
            while len(tried) < 60:
                batch = tune.proposals("hgb", tried, tune.BATCH, seed)
                for p in batch:
                    assert all(lo <= p[n] <= hi for n, (_, lo, hi) in tune.SPACES["hgb"].items()) and isinstance(p["depth"], int)
                tried += [(p, score(p)) for p in batch]
            won += max(s for _, s in tried) >= max(map(score, plain))
            if not seed:
                assert batch == tune.proposals("hgb", tried[:-tune.BATCH], tune.BATCH, seed)
    assert won >= 18
    odd = [(p, float("nan")) for p in tune.draws("ridge", 3, 1)]
    assert len(tune.proposals("ridge", odd, 2, 1)) == 2


def test_density_preset_spends_its_budget(spark, orders_feats):
    from quarry.operators.tune import STARTUP, draws, tune
    _, table = tune(orders_feats, "sum_price", ["n_lines"], "r", "ridge", "l_orderkey", mode="bayes", trials=33, k=2)
    got = [r["params"] for r in table.orderBy("draw").collect()]
    assert len(got) == 33 and got[:STARTUP] == [str(sorted(p.items())) for p in draws("ridge", STARTUP, 42)]
    assert got[STARTUP:] != [str(sorted(p.items())) for p in draws("ridge", 33, 42)][STARTUP:]


def test_keyless_mi_ignores_the_partitioning(spark, orders_feats):
    from quarry.operators import assoc
    d = orders_feats.select("n_lines", "sum_qty", "sum_price")
    got = [assoc.associate(d.repartition(n), "sum_price", "regression", ["mi"], inputs=["n_lines", "sum_qty"])[0]
           .orderBy("feature").select("score").collect() for n in (1, 7)]
    assert [round(r[0], 9) for r in got[0]] == [round(r[0], 9) for r in got[1]]


def _exact_svr(kernel, y, c, epsilon):
    """Fit of the exact kernel with the epsilon-insensitive loss, on its eigenvectors:
    plain Newton steps with corners that sharpen."""
    s, u = np.linalg.eigh(kernel)
    a = np.column_stack([(u * np.sqrt(np.maximum(s, 0)))[:, s > 1e-9 * s.max()], np.ones(len(y))])
    ridge = np.append(np.ones(a.shape[1] - 1), 1e-9)
    theta = np.append(np.zeros(a.shape[1] - 1), y.mean())

    def cost(theta, width):
        over = np.maximum(np.abs(y - a @ theta) - epsilon, 0)
        return (ridge * theta**2).sum() / 2 + c * np.where(over < width, over**2 / (2 * width), over - width / 2).sum()

    width = 2 * y.std()
    while width > epsilon / 10:
        for _ in range(30):
            r = y - a @ theta
            over = np.maximum(np.abs(r) - epsilon, 0)
            g = ridge * theta - c * (np.sign(r) * np.minimum(over / width, 1)) @ a
            near = a[(over > 0) & (over < width)]
            step, size = np.linalg.solve(np.diag(ridge) + c * near.T @ near / width, g), 1.0
            while cost(theta - size * step, width) > cost(theta, width) and size > 1e-6:
                size /= 2
            theta = theta - size * step
        width /= 4
    return a @ theta


def test_svr_follows_a_smooth_curve(spark):
    d = spark.range(1000).select("id", (F.col("id") / 100.0).alias("x")).withColumn("y", 10 * F.sin("x") + 50)
    for profile in ("core", "gui"):
        m = models.fit(d, "y", ["x"], "regression", "svr", profile)
        p = m.transform(d).toPandas()
        x = (p.x - p.x.mean()) / p.x.std(ddof=0)
        kernel = np.exp(-np.subtract.outer(x.values, x.values) ** 2)
        c = m.params["C"]
        exact = _exact_svr(kernel, p.y.to_numpy(), c, m.params["epsilon"])
        line = np.polyval(np.polyfit(p.x, p.y, 1), p.x)
        sse = lambda z: ((p.y - z) ** 2).sum()
        assert sse(p.y_pred) < 0.05 * sse(line)
        assert np.abs(p.y_pred - exact).max() < 0.5


def test_svr_reaches_the_least_of_its_objective(spark, tmp_path):
    """Brute force: the unrounded objective over all rows is no lower anywhere near,
    and the rounded one's gradient is zero; epsilon and outliers act as they should."""
    from quarry.operators import svr
    from quarry.sources import runs
    rng = np.random.default_rng(4)
    x = rng.uniform(-3, 3, (700, 2))
    y = np.sin(x[:, 0]) * 4 + x[:, 1] + rng.standard_normal(700) * 0.3
    y[::50] += 40                                           # outliers pull with a bounded force
    d = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    preds = {}
    for epsilon in (0.0, 0.1, 2.0):
        m = models.fit(d, "y", ["a", "b"], "r", "svr", "gui", epsilon=epsilon, components=60)
        got = m.pipeline.transform(d).orderBy("id").toPandas()
        z = np.stack([v.toArray() for v in got["features"]])
        score = m.pipeline.stages[-1]
        w, b = np.array(score.getOrDefault("coefficients")), score.getOrDefault("intercept")
        delta = 0.1 * epsilon if epsilon else 1e-3 * y.std()

        def objective(w, b, e, c=m.params["C"], z=z):
            return (w @ w) / 2 + c * np.maximum(np.abs(y - z @ w - b) - e, 0).sum()

        slope = svr.loss_slope_curve(y - z @ w - b, epsilon, delta)[1]
        c = m.params["C"]
        assert np.abs(w - c * slope @ z).max() < 1e-6 * c * 700 and abs(slope.sum()) < 1e-5 * 700
        best = objective(w, b, epsilon)
        slack = c * 700 * delta / 2                         # the most that rounding can cost
        for _ in range(200):
            assert objective(w + rng.standard_normal(60) * 0.05, b + rng.standard_normal() * 0.05, epsilon) >= best - slack
        preds[epsilon] = got["prediction"].to_numpy()
        clean = np.delete(np.arange(700), np.arange(0, 700, 50))
        assert np.abs(preds[epsilon] - np.where(np.isin(np.arange(700), clean), y, y - 40)).mean() < 0.5 + epsilon
    assert np.abs(preds[0.1] - preds[2.0]).max() > 0.3
    out = f"file://{tmp_path}/svr"
    runs.save_model(m, out)
    runs.save_manifest(spark, out, m, 42)
    assert np.allclose(runs.load_model(spark, out).transform(d).orderBy("id").toPandas()["y_pred"], preds[2.0])
    flat = models.fit(d.withColumn("y", F.lit(3.0)), "y", ["a", "b"], "r", "svr")
    assert flat.transform(d.drop("y")).agg(F.min("y_pred"), F.max("y_pred")).first() == (3.0, 3.0)


def test_saved_runs_score_and_explain(spark, orders_feats, tmp_path):
    from quarry.plans.explain_job import explain_run
    from quarry.plans.score import score_run
    from quarry.plans.train import train_model
    data = str(tmp_path / "data.parquet")
    orders_feats.write.parquet(data)
    for kind in ("ridge", "knn"):
        run = str(tmp_path / kind)
        r = train_model(orders_feats, "sum_price", ["n_lines", "sum_qty"], "regression", kind, key="l_orderkey", out_dir=run,
                        data_path=data, cv=kind == "knn")
        assert r.metrics.count() == 2
        assert score_run(spark, run).rows_used == orders_feats.count()
    imp, report = explain_run(spark, str(tmp_path / "ridge"), "l_orderkey", repeats=2)
    assert imp.count() == 2 and report.first()["n_samples"] == orders_feats.count()


def test_boosted_shap_without_arrow(spark):
    """Sessions without Arrow build the node table too."""
    df = spark.createDataFrame([(i, float(i % 13), float(i * 7 % 11), float(i % 13) + (i * 7 % 11) ** 2) for i in range(120)],
                               "id long, a double, b double, y double")
    m = models.fit(df, "y", ["a", "b"], "regression", "hgb", rounds=3, min_leaf=2)
    old = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        r = shap.shap_gaps(m, df, 1e-9).first()
        assert (r["rows_off"], r["n"]) == (0, 120)
        assert {x["feature"] for x in shap.shap_importance(m, df).collect()} == {"a", "b"}
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", old)


def test_looked_up_path_values_equal_quadrature(monkeypatch):
    rng = np.random.default_rng(3)
    x, d = rng.standard_normal((70, 5)), 4
    feature = np.stack([np.sort(rng.permutation(5)[:d]) for _ in range(30)]).astype(np.int32)
    low, high = rng.normal(-1, 0.5, (30, d)), rng.normal(1, 0.5, (30, d))
    share, value = rng.uniform(0.1, 0.9, (30, d)), rng.standard_normal((30, 2))
    for i in range(30):             # padding of shorter paths
        low[i, 1 + i % d:], high[i, 1 + i % d:], share[i, 1 + i % d:] = np.nan, np.nan, 1.0
    found = shap.path_values(x, feature, low, high, share, value)
    monkeypatch.setattr(shap, "TABLE_ENTRIES", 0)
    assert np.allclose(found, shap.path_values(x, feature, low, high, share, value), atol=1e-12)


def test_svr_started_from_a_stride_has_the_same_solution(spark, monkeypatch):
    """The start, the tasks and the blocks do not change the solution."""
    from quarry.operators import svr
    d = spark.range(240).select("id", (F.col("id") / 40.0).alias("a"), F.sin(F.col("id") / 40.0).alias("y"))
    plain = models.fit(d, "y", ["a"], "r", "svr", "gui", components=8).pipeline.stages[-1]
    monkeypatch.setattr(svr, "START_ROWS", 100)
    monkeypatch.setattr(svr, "TASK_ROWS", 120)
    monkeypatch.setattr(svr, "BLOCK_ROWS", 50)
    started = models.fit(d, "y", ["a"], "r", "svr", "gui", components=8).pipeline.stages[-1]
    assert np.allclose(plain.getOrDefault("coefficients"), started.getOrDefault("coefficients"), atol=1e-4)
    assert abs(plain.getOrDefault("intercept") - started.getOrDefault("intercept")) < 1e-4
