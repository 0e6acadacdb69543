import numpy as np
import pytest

from quarry.operators import boost, models, shap
from quarry.sources import runs


def plain(x, y, loss, classes, rounds, lr, depth, l2, min_leaf, min_hess, curve=1.0):
    """Boosting row by row, every value a threshold."""
    if loss == "squared":
        m = np.full((len(y), 1), y.mean())
    elif loss == "logistic":
        m = np.full((len(y), 1), np.log(y.mean() / (1 - y.mean())))
    else:
        m = np.repeat(np.log(np.array([(y == c).mean() for c in range(classes)]))[None, :], len(y), 0)
    for _ in range(rounds):
        if loss == "squared":
            g, h = m - y[:, None], np.ones_like(m)
        elif loss == "logistic":
            q = 1 / (1 + np.exp(-m))
            g, h = q - y[:, None], q * (1 - q)
        else:
            q = np.exp(m) / np.exp(m).sum(1, keepdims=True)
            g, h = q - (y[:, None] == np.arange(classes)), curve * q * (1 - q)
        for k in range(m.shape[1]):
            def grow(rows, left, k=k, g=g, h=h):
                best = None
                gs, hs = g[rows, k], h[rows, k]
                if left:
                    for f in range(x.shape[1]):
                        for t in np.unique(x[rows, f])[:-1]:
                            low = x[rows, f] <= t
                            a, b = (gs[low].sum(), hs[low].sum()), (gs[~low].sum(), hs[~low].sum())
                            if min(low.sum(), (~low).sum()) < min_leaf or min(a[1], b[1]) < min_hess:
                                continue
                            gain = a[0]**2 / (a[1] + l2) + b[0]**2 / (b[1] + l2) - gs.sum()**2 / (hs.sum() + l2)
                            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-10)):
                                best = gain, f, t
                if best is None:
                    m[rows, k] -= lr * gs.sum() / (hs.sum() + l2)
                    return
                low = x[rows, best[1]] <= best[2]
                grow(rows[low], left - 1)
                grow(rows[~low], left - 1)
            grow(np.arange(len(y)), depth)
    return m


def _frame(spark, x, y):
    rows = [(int(i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", y double")


@pytest.mark.parametrize("loss, settle", [("squared", 2), ("logistic", 10), ("softmax", 10)])
def test_trees_match_plain_boosting(spark, monkeypatch, loss, settle):
    monkeypatch.setattr(boost, "SETTLE", settle)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(0, 12, 400), np.round(rng.standard_normal(400), 1), rng.integers(0, 2, 400)], 1).astype(float)
    signal = x[:, 0] / 3 + x[:, 1] * (x[:, 2] - 0.4) + 0.3 * rng.standard_normal(400)
    y = {"squared": signal, "logistic": (signal > 2).astype(float), "softmax": np.digitize(signal, [1, 2.5]).astype(float)}[loss]
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(_frame(spark, x, y)).withColumnRenamed("y", "label")
    args = dict(rounds=5, lr=0.4, depth=3, l2=1.0, min_leaf=4, min_hess=0.5)
    m = boost.fit_boosted(df.repartition(3), loss, 3 if loss == "softmax" else 2, curve=2.0, **args)
    want = plain(x, y, loss, 3, curve=2.0, **args)
    assert np.allclose(boost.margins(m.content, x), want, atol=1e-8)
    one = boost.fit_boosted(df.coalesce(1), loss, 3 if loss == "softmax" else 2, curve=2.0, **args)
    assert np.allclose(boost.margins(one.content, x), want, atol=1e-8)


def test_penalty_sampling_and_saved_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 3))
    y = x[:, 0] * 2 + np.sin(3 * x[:, 1])
    df = _frame(spark, x, y)
    inputs = ["x0", "x1", "x2"]
    fits = {l2: models.fit(df, "y", inputs, "r", "xgb", rounds=3, depth=2, l2=l2) for l2 in (1.0, 500.0)}
    spread = {l2: m.transform(df).toPandas()["y_pred"].std() for l2, m in fits.items()}
    assert spread[500.0] < spread[1.0] / 2
    a = models.fit(df, "y", inputs, "r", "xgb", "gui", rounds=4)
    b = models.fit(df.repartition(5), "y", inputs, "r", "xgb", "gui", rounds=4)
    pa, pb = (m.transform(df).orderBy("id").toPandas()["y_pred"] for m in (a, b))
    assert np.allclose(pa, pb, atol=1e-9)           # the sample does not depend on the partitioning
    out = f"file://{tmp_path}/m"
    runs.save_model(a, out)
    runs.save_manifest(spark, out, a, 42)
    assert np.allclose(runs.load_model(spark, out).transform(df).orderBy("id").toPandas()["y_pred"], pa)
    assert shap.shap_gaps(a, df, 1e-9).first() == (0, 600)


def test_many_values_fall_into_bins(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 1))
    m = models.fit(_frame(spark, x, np.sign(x[:, 0])), "y", ["x0"], "r", "hgb", rounds=3, lr=1.0, bins=16)
    content = m.pipeline.stages[-1].content
    assert len({t for r in content["trees"] for tree in r for t in tree["threshold"]}) <= 16
    assert np.corrcoef(boost.margins(content, x)[:, 0], np.sign(x[:, 0]))[0, 1] > 0.9


def test_constant_inputs_and_one_row(spark):
    m = models.fit(_frame(spark, np.ones((5, 1)), np.arange(5.0)), "y", ["x0"], "r", "xgb", rounds=2)
    assert m.transform(_frame(spark, np.ones((1, 1)), [0.0])).first()["y_pred"] == pytest.approx(2.0)


def test_tasks_send_filled_cells_and_get_even_rows(spark):
    """A one-partition table is dealt to all cores, and empty cells stay in the tasks."""
    from quarry.session import spread
    sizes = spread(spark.range(400).coalesce(1), 400, 10).rdd.glom().map(len).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
    b = np.array([[0, 7], [3, 7], [0, 9]], np.uint8)
    block = b, np.array([1.0, 2.0, 4.0]), np.zeros((3, 1)), np.zeros(3, np.uint64)
    p = {"subsample": 1.0, "curve": 1.0, "seed": 0}
    root = boost._Tree(np.arange(2)).arrays()
    (cells, sums), = boost._level_sums([block], ([], [root], [[0]]), "squared", 0, p, 256)
    assert cells.tolist() == [0, 3, 256 + 7, 256 + 9]
    assert sums.tolist() == [[-5, 2, 2], [-2, 1, 1], [-3, 2, 2], [-4, 1, 1]]
    both = boost._merged((cells, sums), (np.array([3, 5]), np.ones((2, 3))))
    assert both[0].tolist() == [0, 3, 5, 263, 265] and both[1][1].tolist() == [-1, 2, 2]
