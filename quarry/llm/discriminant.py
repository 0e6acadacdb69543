"""Operator 11: quality classifier, a regularised quadratic discriminant.

Document statistics (``quality.statistics``) are transformed so that they are
closer to normal within a class: shares by the arcsine root, rates by the square
root, sizes by logarithms. Each class has a mean and a covariance; the covariance
is shrunk towards the pooled one by ``POOL`` and towards a multiple of the identity
by ``ROUND``. The score is the logistic of the difference of the two log densities
(Mahalanobis distance by the cached Cholesky factor, log determinant, log share of
the class).

The statistics of every text are computed once and written; the moments are sums
over all labelled training rows, joined by doc_id (no text is shuffled, nothing is
sampled); scores are computed from the written statistics.

Defined cases: a null or empty text has the statistics zero and a score like any
other; a document labelled twice counts with its least label; repeated rows are
scored row by row and count as often in training; a null doc_id is never held out
and has no label; without labels of both classes every score is the smoothed share
of label 1, (n1 + 1) / (n + 2); an empty table gives an empty result; other columns
are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, map_by_id, saved
from quarry.llm.quality import FEATURES, statistics

POOL, ROUND = 0.3, 0.01
GOOD_FROM = 0.7
DIGITS = 9              # of a score: sums in another order differ below
FLOOR = 1e-6            # least standard deviation of a statistic

_ROOT = {"symbols_per_word", "bang_per_word", "pipe_per_word", "stop_per_word"}
_SHARE = {"dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share"}
NAMES = list(FEATURES)


def transform(x: np.ndarray) -> np.ndarray:
    """Statistics (rows x ``NAMES``) made closer to normal."""
    out = np.empty_like(x, dtype=float)
    for k, name in enumerate(NAMES):
        v = x[:, k]
        if name in _SHARE:
            out[:, k] = np.arcsin(np.sqrt(np.clip(v, 0, 1)))
        elif name in _ROOT:
            out[:, k] = np.sqrt(np.log1p(v))
        elif name == "log_words":
            out[:, k] = v
        else:
            out[:, k] = np.log1p(v)
    return out


# ---- the model ---------------------------------------------------------------

def fit_moments(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pool: float = POOL, rounded: float = ROUND) -> dict:
    """The discriminant from each class's (0, 1) row count, sums and sums of
    products of the transformed statistics."""
    total = n.sum()
    if (n == 0).any():
        return {"share": float((n[1] + 1) / (total + 2))}
    mean_all = s.sum(0) / total
    scale = np.maximum(np.sqrt(np.maximum(np.diag(ss.sum(0)) / total - mean_all**2, 0)), FLOOR)
    means, covs = [], []
    for c in (0, 1):
        m = s[c] / n[c]
        means.append((m - mean_all) / scale)
        covs.append((ss[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    d = len(scale)
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - pool) * covs[c] + pool * pooled
        cov = (1 - rounded) * cov + (rounded * max(np.trace(cov) / d, FLOOR)) * np.eye(d)
        low = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log(n[c] / total) - np.log(np.diag(low)).sum()))
    return {"centre": mean_all, "scale": scale, "means": means, "factors": factors, "offsets": offsets}


def predict(model: dict, z: np.ndarray) -> np.ndarray:
    """Score of transformed statistics."""
    if "share" in model:
        return np.full(len(z), model["share"])
    w = (z - model["centre"]) / model["scale"]
    log = [model["offsets"][c] - 0.5 * (((w - model["means"][c]) @ model["factors"][c].T) ** 2).sum(1) for c in (0, 1)]
    return np.round(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), DIGITS)


# ---- on Spark ------------------------------------------------------------

def held_out() -> Column:
    """One document of four by the checksum of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and z (the transformed statistics) of every row, written."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = transform(np.array([statistics(t)[5] for t in b["text"]], float))
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(object), "z": list(x)})

    return saved(map_by_id(docs.select("doc_id", "text"), run, "z array<double>"))


def fit(rows: DataFrame, labels: DataFrame) -> dict:
    """The model from ``described`` rows that ``labels`` (doc_id, quality) covers:
    one aggregate over all of them."""
    marks = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).where("y in (0, 1)"))
    d = len(NAMES)
    z = [F.col("z")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = (rows.join(marks, "doc_id").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in z]).alias("s"),
        F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("ss")).collect())   # two rows
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums:
        n[r["y"]], s[r["y"]] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["ss"], strict=True):
            ss[r["y"], i, j] = ss[r["y"], j, i] = v
    return fit_moments(n, s, ss)


def score(rows: DataFrame, model: dict, good_from: float = GOOD_FROM) -> DataFrame:
    """doc_id, held_out, score and predicted of ``described`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(object), "score": predict(model, np.stack(b["z"].to_numpy()))})

    out = map_by_id(rows.select("doc_id", "z"), run, "score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= good_from).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted; the model learns
    from the documents that are not held out."""
    rows = described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return score(rows, fit(rows.where(~held_out()), labels))
