import numpy as np
import pytest
from brute import mi_cc
from pyspark.sql import functions as F

from quarry.operators import mi_reg


def _points(kind, n, rng):
    x = {"normal": rng.standard_normal, "heavy": rng.standard_cauchy, "levels": lambda n: rng.integers(1, 6, n) + 1e-10 * rng.random(n),
         "hot": lambda n: np.where(rng.random(n) < 0.4, 0, rng.standard_normal(n)) + 1e-10 * rng.random(n)}[kind](n)
    return np.stack([x, x + rng.standard_normal(n)], 1)


@pytest.mark.parametrize("kind", ["normal", "heavy", "levels", "hot"])
def test_neighbours_of_cells_match_brute_force(kind):
    rng = np.random.default_rng(4)
    p, q = _points(kind, 700, rng), _points(kind, 90, rng)
    tree = mi_reg.Buckets(p)
    d = np.abs(p[:, None, :] - p[None, :, :]).max(2)
    np.fill_diagonal(d, np.inf)
    assert (tree.nearest(p, 3, own=np.arange(len(p))) == np.sort(d, 1)[:, :3]).all()
    far = np.sort(np.abs(q[:, None, :] - p[None, :, :]).max(2), 1)[:, :3]
    bound = far[:, 1].copy()
    got = tree.nearest(q, 3, bound=bound)
    assert (got[:, :2] == far[:, :2]).all()         # what lies beyond the bound is not looked for
    plane = mi_reg.Partition(p[::3], 8)
    cell = plane.locate(p)
    assert 6 <= plane.n <= 12 and set(cell) <= set(range(plane.n))
    pairs = set(zip(*[v.tolist() for v in plane.met(q, bound)], strict=True))
    need = {(i, int(cell[j])) for i in range(len(q)) for j in np.flatnonzero(np.abs(q[i] - p).max(1) <= bound[i])}
    assert need <= pairs
    assert len(pairs) < 6 * len(q)


def test_two_points_and_equal_points():
    tree = mi_reg.Buckets(np.zeros((2, 2)))
    assert tree.nearest(np.zeros((2, 2)), 3, own=np.arange(2)).tolist() == [[0.0, np.inf, np.inf]] * 2


def test_scores_match_brute_force_on_any_partitioning(spark, monkeypatch):
    """Three inputs in one job, cells of about 60 rows."""
    monkeypatch.setattr(mi_reg, "LEAF_ROWS", 60)
    rng = np.random.default_rng(8)
    n = 900
    a, b = rng.standard_cauchy(n), np.where(rng.random(n) < 0.35, 0.0, rng.standard_normal(n))
    c, y = rng.integers(0, 5, n).astype(float), rng.standard_normal(n)
    y = y + c
    rows = [(int(i), *map(float, v)) for i, v in enumerate(zip(a, b, c, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    one = mi_reg.mi_regression(df.repartition(1), ["a", "b", "c"], "y", "id")
    assert one == pytest.approx(mi_reg.mi_regression(df.repartition(9), ["a", "b", "c"], "y", "id"), abs=1e-12)
    e = mi_reg._scaled(df, ["a", "b", "c", "y"], "id", 0, True)["columns"]
    d = df.select(*[v.alias(k) for k, v in e.items()]).toPandas()
    for f in ("a", "b", "c"):
        assert one[f] == pytest.approx(mi_cc(d[f].values, d["y"].values, 3), abs=1e-9)


def test_without_jitter_equal_points_have_radius_zero(spark, monkeypatch):
    monkeypatch.setattr(mi_reg, "LEAF_ROWS", 80)
    rng = np.random.default_rng(9)
    x = np.where(rng.random(800) < 0.4, 0, rng.integers(0, 30, 800)).astype(float)
    y = np.round(x / 10 + rng.standard_normal(800), 1)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y, strict=True)], "x double, y double")
    got = mi_reg.mi_regression(df, ["x"], "y", None, jitter=False)["x"]
    # values on a grid tie: a tie with the k-th neighbour is not strictly closer, whatever rounding says
    dx, dy = (np.abs(v[:, None] - v[None, :]) / v.std() for v in (x, y))
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.sort(d, 1)[:, 2] * (1 - 1e-9)
    inside = [((m <= eps[:, None]).sum(1)).astype(float) for m in (dx, dy)]
    psi = mi_reg._psi
    want = psi(np.array([800.0]))[0] + psi(np.array([3.0]))[0] - psi(inside[0]).mean() - psi(inside[1]).mean()
    assert got == pytest.approx(max(0.0, want), abs=1e-9) and want > 0


def test_equal_rows_without_a_key_are_numbered(spark, monkeypatch):
    from quarry.operators import assoc, mi
    monkeypatch.setattr(mi, "COPY_BLOCK", 7)
    df = spark.createDataFrame([(float(i % 4), float(i % 3)) for i in range(240)], "x double, y double")
    scores = {assoc.associate(df.repartition(p), "y", "regression", ["mi"], inputs=["x"])[0].first()["score"] for p in (1, 5)}
    assert len(scores) == 1
    few = df.limit(2).withColumn("y", F.monotonically_increasing_id().cast("double"))
    assert assoc.associate(few, "y", "regression", ["mi"], inputs=["x"])[0].where("score is not null").count() == 0


def test_asks_that_crowd_beside_levels_are_dealt_into_blocks(spark, monkeypatch):
    """All intervals around a level end in the gaps beside it, in ranges of few values;
    the points of a level cut along x all ask the thinner part of it."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    monkeypatch.setattr(mi_reg, "LEAF_ROWS", 20)
    apply = PandasCogroupedOps.applyInPandas

    def bounded(self, func, schema):
        def run(p, q):
            assert len(q) <= 160, f"{len(q)} rows in one group"
            return func(p, q)
        return apply(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", bounded)
    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, 1500).astype(float)
    y = x + rng.standard_normal(1500)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    got = mi_reg.mi_regression(df, ["x"], "y", "id")["x"]
    d = df.select(*[v.alias(k) for k, v in mi_reg._scaled(df, ["x", "y"], "id", 0, True)["columns"].items()]).toPandas()
    assert got == pytest.approx(mi_cc(d["x"].values, d["y"].values, 3), abs=1e-9)
