"""Support vector regression (E8) on random Fourier features: the objective

    |w|^2 / 2 + C * sum over rows of loss(y - b - w.z(x))

with the epsilon-insensitive loss, whose two corners are rounded over a width delta:
0 within epsilon, (|r| - epsilon)^2 / (2 delta) up to epsilon + delta, and the line
|r| - epsilon - delta / 2 beyond. It is solved by Newton steps, whose best size of
``SIZES`` one pass finds, on a
delta that starts at the target's spread and shrinks to ``EDGE`` * epsilon (for an
epsilon of 0 to a thousandth of the spread), so the far rows' pull stays constant and
outliers count as in the unrounded loss.

Rows are dealt evenly to the cores (``session.spread``) and packed once into cached
blocks of standardised inputs; a task maps its blocks to features anew in every pass
and adds up gradient and the outer products of the rows in the two corners (the
upper triangle is sent, only if a corner has rows). The sums of several tasks are
added up by tasks; the driver gets one array and solves one linear system a step.

The loss is strictly convex in w, so where the steps start does not change what they
end at: a table of more than ``START_ROWS`` rows starts the last width from the
solution on a stride of its rows, with C scaled to their share. The widths before the
last are only a way there and are solved to ``ROUGH``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rff import rff_weights
from quarry.session import spread

BLOCK_ROWS = 4_096
EDGE = 0.1                  # final width of a corner, in epsilons
SHRINK = 8.0                # a width and the next
MAX_STEPS = 50              # Newton steps per width
TOLERANCE = 1e-9            # of a gradient entry, per unit of C and row
SIZES = 2.0 ** -(np.arange(28) / 2)     # of a Newton step
ROUGH = 1e-5                # the same at widths before the last
TASK_ROWS = 2_048           # least rows of a task
START_ROWS = 20_000         # rows of the fit that gives a large table its start


class LinearScore(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """prediction = intercept + coefficients . features, as a pipeline stage."""

    coefficients = Param(Params._dummy(), "coefficients", "one per feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, coefficients=None, intercept=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _transform(self, df):
        w, b = np.array(self.getOrDefault(self.coefficients)), self.getOrDefault(self.intercept)

        @F.pandas_udf("double")
        def score(col: pd.Series) -> pd.Series:
            return pd.Series(np.stack(col.to_numpy()) @ w + b if len(col) else np.zeros(0))

        return df.withColumn(self.getOrDefault(self.predictionCol), score(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))


def loss_slope_curve(r: np.ndarray, epsilon: float, delta: float):
    """The rounded loss of residuals, its derivative, and where its curvature is 1 / delta."""
    over = np.maximum(np.abs(r) - epsilon, 0.0)
    corner = (over > 0) & (over < delta)
    loss = np.where(over < delta, over**2 / (2 * delta), over - delta / 2)
    return loss, np.sign(r) * np.minimum(over / delta, 1.0), corner


def _sums(blocks, features, theta, epsilon, delta):
    """[gradient, curvature] of some blocks, flat; the last feature is the constant."""
    k = len(theta)
    gradient, curvature = np.zeros(k), np.zeros((k, k))
    for x, y in blocks:
        z = np.column_stack([features(x), np.ones(len(x))])
        _, slope, corner = loss_slope_curve(y - z @ theta, epsilon, delta)
        gradient -= slope @ z
        if corner.any():
            z = z[corner]
            curvature += z.T @ z / delta
    yield np.concatenate([gradient, curvature[np.triu_indices(k)]])


def _line(blocks, features, theta, step, epsilon, delta):
    """The losses of some blocks at theta - size * step, for all sizes."""
    loss = np.zeros(len(SIZES))
    for x, y in blocks:
        z = np.column_stack([features(x), np.ones(len(x))])
        r, change = y - z @ theta, z @ step
        loss += [loss_slope_curve(r + size * change, epsilon, delta)[0].sum() for size in SIZES]
    yield loss


def fit_svr(df: DataFrame, x_col: str, dim: int, components: int, gamma: float, seed: int, c: float, epsilon: float,
            spread_: float) -> LinearScore:
    """Coefficients on the features that ``rff`` draws for these parameters, from the
    standardised inputs in ``x_col`` and ``label``, whose spread is ``spread_``."""
    weights, shift = rff_weights(dim, components, gamma, seed)

    def features(x):
        return np.sqrt(2.0 / components) * np.cos(x @ weights + shift)

    def pack(rows):
        held = []
        for r in rows:
            held.append((*r["x"], r["y"]))
            if len(held) == BLOCK_ROWS:
                yield np.array(held)[:, :-1], np.array(held)[:, -1]
                held = []
        if held:
            yield np.array(held)[:, :-1], np.array(held)[:, -1]

    data = df.select(vector_to_array(x_col).alias("x"), F.col("label").cast("double").alias("y")).persist()
    n = data.count()
    if not n:
        raise ValueError("no rows to fit")
    blocks = spread(data, n, TASK_ROWS).rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
    mean = blocks.map(lambda b: float(b[1].sum())).sum() / n
    k = components + 1
    penalty = np.append(np.ones(components), 0.0)
    last = EDGE * epsilon if epsilon > 0 else 1e-3 * spread_
    upper = np.triu_indices(k)

    def solved(blocks, n, c, theta, delta):
        """Newton steps on ``blocks`` of ``n`` rows, from ``theta`` and the width ``delta`` on."""
        def at(theta, delta):
            parts = blocks.mapPartitions(lambda it: _sums(it, features, theta, epsilon, delta))
            if blocks.getNumPartitions() > 1:
                parts = parts.map(lambda s: (0, s)).reduceByKey(lambda a, b: a + b, 1).values()
            s = parts.collect()[0]
            curvature = np.zeros((k, k))
            curvature[upper] = c * s[k:]
            curvature = curvature + np.triu(curvature, 1).T + np.diag(penalty)
            return c * s[:k] + penalty * theta, curvature

        while True:
            gradient, curvature = at(theta, delta)
            for _ in range(MAX_STEPS):
                if np.abs(gradient).max() <= (TOLERANCE if delta <= last else ROUGH) * c * n:
                    break
                # without rows in a corner nothing holds the constant: a trace of curvature does
                curvature[-1, -1] += 1e-9 * c * n / delta
                step = np.linalg.solve(curvature, gradient)
                losses = blocks.mapPartitions(lambda it, theta=theta, step=step, delta=delta: _line(it, features, theta, step, epsilon, delta))
                values = [c * v + (penalty * (theta - size * step)**2).sum() / 2 for v, size in zip(sum(losses.collect()), SIZES, strict=True)]
                theta = theta - SIZES[int(np.argmin(values))] * step
                gradient, curvature = at(theta, delta)
            if delta <= last:
                return theta
            delta = max(delta / SHRINK, last)

    theta = np.append(np.zeros(components), mean)
    if spread_ > 0:
        delta = max(2 * spread_, last)
        if n > 2 * START_ROWS:
            stride = n // START_ROWS
            few = blocks.map(lambda b: (b[0][::stride], b[1][::stride])).persist(StorageLevel.MEMORY_AND_DISK)
            m = few.map(lambda b: len(b[1])).sum()
            theta, delta = solved(few, m, c * n / m, theta, delta), last
            few.unpersist()
        theta = solved(blocks, n, c, theta, delta)
    blocks.unpersist()
    data.unpersist()
    return LinearScore(coefficients=theta[:-1].tolist(), intercept=float(theta[-1]))
