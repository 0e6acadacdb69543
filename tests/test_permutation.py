"""Permutation importance (H2): the pairing by md5 order, against plain Python."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quarry.operators import models
from quarry.operators.explain import permutation_importance


@pytest.mark.parametrize("bucket_rows", ["64", "2000000"])
def test_pairs_rows_by_position(spark, bucket_rows):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=900), rng.integers(0, 9, 900).astype(float)
    y = 2 * x + z + rng.normal(size=900)
    df = spark.createDataFrame(list(zip(range(900), x.tolist(), z.tolist(), y.tolist(), strict=True)), "id long, x double, z double, y double")
    m = models.fit(df, "y", ["x", "z"], "regression", "linear")
    spark.conf.set("spark.quarry.rowsPerBucket", bucket_rows)
    try:
        imp = permutation_importance(m, df, "id", repeats=3, seed=5)
        # rows and donors go straight to their buckets: no window over the repeats
        assert "Window" not in imp._jdf.queryExecution().toString()
        got = {r["feature"]: r for r in imp.collect()}
    finally:
        spark.conf.set("spark.quarry.rowsPerBucket", "64")

    def order(text):
        return np.array(sorted(range(900), key=lambda i: hashlib.md5(text(i).encode()).hexdigest()))

    est = m.pipeline.stages[-1]

    def r2(a, b, actual):
        p = est.intercept + est.coefficients[0] * a + est.coefficients[1] * b
        return 1 - ((actual - p) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()

    base = order(lambda i: f"5:base:{i}")
    for name in ("x", "z"):
        drops = []
        for rep in range(3):
            donor = order(lambda i, rep=rep: f"5:{i}:{rep}")
            a, b = (x[donor] if name == "x" else x[base]), (z[donor] if name == "z" else z[base])
            drops.append(r2(x, z, y) - r2(a, b, y[base]))
        assert got[name]["importance"] == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[name]["importance_std"] == pytest.approx(np.std(drops), abs=1e-9)
