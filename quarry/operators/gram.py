"""Linear and ridge fits of every fold and penalty from one pass.

One scan sums, per fold, the row count, the means and the centred co-moments of
inputs and target. Each task works on its own rows, and partial results merge by
the pairwise update of Chan, Golub and LeVeque (1979), so nothing cancels. The
moments of "all folds but f" are the total less fold f; from them every fold's
coefficients follow for any penalty, and so does the squared error on the fold
left out. Absolute errors need a second scan, one for all folds and penalties.

What a task sends and the driver holds is folds x (inputs + 1)^2 numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGED_TASKS = 256      # tasks whose moments are merged together


@dataclass
class Moments:
    """n rows, their mean and centred co-moments of (x1 ... xd, y)."""
    n: float
    mean: np.ndarray
    m: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n:
            return other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.m + other.m + np.outer(d, d) * (self.n * other.n / n))

    def __sub__(self, part: Moments) -> Moments:
        """The moments of the rows that are not in ``part``."""
        n = self.n - part.n
        if n <= 0:
            return Moments(0, self.mean * 0, self.m * 0)
        mean = self.mean + (self.mean - part.mean) * (part.n / n)
        d = mean - part.mean
        return Moments(n, mean, self.m - part.m - np.outer(d, d) * (n * part.n / self.n))


def moments_of(z: np.ndarray) -> Moments:
    mean = z.mean(0)
    c = z - mean
    return Moments(len(z), mean, c.T @ c)


def fold_moments(rows: DataFrame) -> dict[int, Moments]:
    """Moments per ``fold`` of rows with a ``features`` vector and a ``label``."""
    data = rows.select("fold", vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))

    def packed(held: dict[int, Moments]) -> pd.DataFrame:
        return pd.DataFrame({"fold": list(held), "n": [v.n for v in held.values()],
                             "mean": [v.mean.tobytes() for v in held.values()], "m": [v.m.tobytes() for v in held.values()]})

    def unpacked(b: pd.DataFrame):
        for fold, n, mean, m in zip(b["fold"], b["n"], b["mean"], b["m"], strict=True):
            mean = np.frombuffer(mean)
            yield int(fold), Moments(n, mean, np.frombuffer(m).reshape(len(mean), len(mean)))

    def sums(batches):
        held: dict[int, Moments] = {}
        for b in batches:
            if len(b):
                z = np.column_stack([np.stack(b["x"].to_numpy()), b["y"].to_numpy()])
                fold = b["fold"].to_numpy()
                for f in np.unique(fold):
                    new = moments_of(z[fold == f])
                    held[int(f)] = held[int(f)] + new if int(f) in held else new
        if held:
            yield packed(held)

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, Moments] = {}
        for f, v in unpacked(b):
            held[f] = held[f] + v if f in held else v
        return packed(held)

    schema = "fold int, n double, mean binary, m binary"
    parts = data.mapInPandas(sums, schema).withColumn("some", F.floor(F.spark_partition_id() / MERGED_TASKS))
    found = parts.groupBy("fold", "some").applyInPandas(merge, schema).groupBy("fold").applyInPandas(merge, schema).toPandas()
    return dict(sorted(unpacked(found)))


def coefficients(m: Moments, alpha: float = 0.0, scale: bool = False) -> np.ndarray:
    """(intercept, b1 ... bd) that minimise the squared error plus alpha |b|^2, on
    standardised inputs if ``scale``; the smallest of equals."""
    xx, xy = m.m[:-1, :-1], m.m[:-1, -1]
    s = np.sqrt(np.diag(xx) / m.n) if scale else np.ones(len(xy))
    s = np.where(s > 0, s, 1.0)
    a = xx / np.outer(s, s) + alpha * np.eye(len(xy))
    b = (np.linalg.solve(a, xy / s) if alpha > 0 else np.linalg.lstsq(a, xy / s, rcond=1e-12)[0]) / s
    return np.append(m.mean[-1] - m.mean[:-1] @ b, b)


def squared_error(m: Moments, b: np.ndarray) -> float:
    """Sum of squared errors of the coefficients on the rows of ``m``."""
    w = np.append(-b[1:], 1.0)
    return float(max(w @ m.m @ w, 0.0) + m.n * (m.mean @ w - b[0]) ** 2)


def r2(m: Moments, b: np.ndarray) -> float:
    sse, sst = squared_error(m, b), float(m.m[-1, -1])
    return 1 - sse / sst if sst > 0 else float(sse <= 1e-12 * max(m.n, 1.0))


def cross_fits(folds: dict[int, Moments], alpha: float = 0.0, scale: bool = False) -> dict[int, np.ndarray]:
    """Coefficients of each fold, fitted on the others."""
    total = None
    for v in folds.values():
        total = v if total is None else total + v
    return {f: coefficients(total - v, alpha, scale) for f, v in folds.items()}


def absolute_errors(rows: DataFrame, fits: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean absolute error per fold, of that fold's coefficients."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    data = rows.select("fold", vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))

    def run(batches):
        for b in batches:
            if len(b):
                x, y, fold = np.stack(b["x"].to_numpy()), b["y"].to_numpy(float), b["fold"].to_numpy()
                c = np.stack([shared.value[int(f)] for f in fold])
                yield pd.DataFrame({"fold": fold, "e": np.abs(y - c[:, 0] - (x * c[:, 1:]).sum(1))})

    return {r["fold"]: r["e"] for r in data.mapInPandas(run, "fold int, e double").groupBy("fold").agg(F.avg("e").alias("e")).collect()}
