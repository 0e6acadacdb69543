"""Operator 1: quality rules as gradient-boosted trees over document statistics.

``statistics`` turns a text into counts, ``base_rules`` applies the two fixed
rules, and a small boosted model judges the rest. The model is fitted on a
bounded sample of labelled documents (``MAX_TRAIN_ROWS`` rows with the smallest
hash of doc_id), binned and grown as histogram trees whose splits respect
monotonic constraints, then flattened into numpy node arrays; tasks score whole
batches by walking all rows down a tree level by level. Statistics and verdicts
cover every document and whole texts.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; repeated rows are judged row by row; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored. Without labels
of both classes there is no model and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, map_by_id, words_of

MAX_TRAIN_ROWS = 20_000     # labelled documents the model is fitted on, at most
TREES = 40
DEPTH = 3
BINS = 64
RATE = 0.25
L2 = 1.0
MIN_LEAF = 20
KEEP_FROM = 0.5             # least probability of good quality of a kept document

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Model inputs and their monotonic constraint on "good quality": -1 means more
# of it never raises the score.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1,
    "repeat_share": -1, "upper_share": -1, "bang_per_word": -1, "pipe_per_word": -1,
    "digit_share": 0, "distinct_share": 0, "words_per_line": 0, "stop_per_word": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def repeated_words(ids: np.ndarray, n_ids: int, window: int = WINDOW) -> int:
    """Words covered by a ``window``-word sequence that occurs at least twice.
    Windows are ranked exactly: while the combined key would overflow, ranks of
    the part built so far replace it."""
    if len(ids) <= window:
        return 0
    ids = ids.astype(np.int64)
    key, size = ids, max(n_ids, 1)
    for k in range(1, window):
        if size > (1 << 62) // max(n_ids, 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = int(key.max()) + 1
        key = key[:-1] * n_ids + ids[k:]
        size *= n_ids
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features)."""
    words = words_of(text)
    n = len(words)
    if not n:
        # white space alone: no words, and no line has a word
        return 0, 0, 0, 0, 0, [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    word_chars = len(text) - int(by_byte[_SPACE].sum())
    n_symbols = int(by_byte[_SYMBOLS].sum())
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n_lines += 1
            if line in seen:
                n_dup += 1
            seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n_repeat = repeated_words(ids, len(known))
    upper, lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    features = [
        float(np.log1p(n)), word_chars / n, n_symbols / n, n_dup / n_lines, n_repeat / n,
        upper / max(upper + lower, 1), int(by_byte[33]) / n, int(by_byte[124]) / n,
        int(by_byte[48:58].sum()) / word_chars, len(known) / n, n / n_lines, int(by_byte[46]) / n,
    ]
    return n, word_chars, n_symbols, n_dup, n_repeat, features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


# ---- the model -----------------------------------------------------------

def _grow(binned, grad, hess, cuts, signs) -> list[tuple]:
    """One tree as nodes (feature, threshold, left, right, value). A split must
    order its children's values by the feature's sign, and the middle of the
    two bounds all values below either child."""
    nodes: list[list] = []

    def leaf_value(rows, low, high):
        g, h = grad[rows].sum(), hess[rows].sum()
        return float(np.clip(-g / (h + L2), low, high))

    def build(rows, depth, low, high) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, leaf_value(rows, low, high)])
        if depth == 0 or len(rows) < 2 * MIN_LEAF:
            return at
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None, 0.0)
        for f, sign in enumerate(signs):
            if not len(cuts[f]):
                continue
            b = binned[rows, f]
            g = np.cumsum(np.bincount(b, grad[rows], BINS))[:-1]
            h = np.cumsum(np.bincount(b, hess[rows], BINS))[:-1]
            n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            vl = np.clip(-g / (h + L2), low, high)
            vr = np.clip(-(g_all - g) / (h_all - h + L2), low, high)
            # twice the loss that the (clipped) leaf values save against one clipped leaf
            v0 = nodes[at][4]
            gain = -(2 * g * vl + (h + L2) * vl**2 + 2 * (g_all - g) * vr + (h_all - h + L2) * vr**2) + 2 * g_all * v0 + (h_all + L2) * v0**2
            bad = (n < MIN_LEAF) | (len(rows) - n < MIN_LEAF) | (sign * (vr - vl) < 0)
            bad[len(cuts[f]):] = True
            gain = np.where(bad, -np.inf, gain)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k] + vr[k]) / 2)
        _, f, k, mid = best
        if f is None:
            return at
        go = binned[rows, f] <= k
        sign = signs[f]
        left = build(rows[go], depth - 1, mid if sign < 0 else low, mid if sign > 0 else high)
        right = build(rows[~go], depth - 1, mid if sign > 0 else low, mid if sign < 0 else high)
        nodes[at][:4] = [f, float(cuts[f][k]), left, right]
        return at

    build(np.arange(len(grad)), DEPTH, -np.inf, np.inf)
    return [tuple(n) for n in nodes]


def fit_trees(x: np.ndarray, y: np.ndarray, signs=tuple(FEATURES.values())) -> dict | None:
    """Boosted trees for P(y = 1) as flat node arrays, None for one class."""
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), prior)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        nodes = _grow(binned, p - y, p * (1 - p), cuts, signs)
        trees.append(nodes)
        score += RATE * _walk(_flat([nodes]), x)
    return _flat(trees) | {"prior": prior}


def _flat(trees: list[list[tuple]]) -> dict:
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    for nodes in trees:
        at = len(feature)
        roots.append(at)
        for f, t, l, r, v in nodes:
            feature.append(f), threshold.append(t), left.append(at + l), right.append(at + r), value.append(v)
    return {"roots": np.array(roots), "feature": np.array(feature), "threshold": np.array(threshold),
            "left": np.array(left), "right": np.array(right), "value": np.array(value)}


def _walk(m: dict, x: np.ndarray) -> np.ndarray:
    """Sum over trees of the leaf each row reaches; a leaf points to itself."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for root in m["roots"]:
        node = np.full(len(x), root)
        for _ in range(DEPTH):
            goes = x[rows, m["feature"][node]] <= m["threshold"][node]
            node = np.where(goes, m["left"][node], m["right"][node])
        total += m["value"][node]
    return total


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Probability of good quality; 1 without a model."""
    if model is None:
        return np.ones(len(x))
    return 1 / (1 + np.exp(-(model["prior"] + RATE * _walk(model, x))))


# ---- on Spark ------------------------------------------------------------

STAT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """The model from documents that ``labels`` (doc_id, quality) covers: at most
    ``max_rows`` labels by smallest hash, so their broadcast is bounded. Where
    doc_ids repeat, the ``max_rows`` rows with the smallest hash of doc_id and
    statistics are taken, whatever the partitioning."""
    bounded_batches(docs.sparkSession)
    sample = (labels.where("doc_id is not null and quality is not null")
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "y": b["y"].to_numpy(),
                                "x": [statistics(t)[5] for t in b["text"]]})

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
            .mapInPandas(features, "doc_id long, y int, x array<double>")
            .orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(max_rows).toPandas())
    if not len(rows):
        return None
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T[::-1], y))     # the model must not depend on the order of collected rows
    return fit_trees(x[order], y[order])


def judge(texts, model: dict | None) -> pd.DataFrame:
    """Counts, ``base_failed``, ``quality`` and ``kept`` of each text."""
    found = [statistics(t) for t in texts]
    out = pd.DataFrame([f[:5] for f in found], columns=COUNTS, dtype="int64")
    out["base_failed"] = [base_failed(f[0], f[4]) for f in found]
    out["base_failed"] = out["base_failed"].astype(bool)
    x = np.array([f[5] for f in found], float).reshape(len(found), len(FEATURES))
    out["quality"] = predict(model, x)
    out["kept"] = ~out["base_failed"] & (out["quality"] >= KEEP_FROM)
    return out


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, ``base_failed``, the model's ``quality``
    and ``kept``."""
    model = fit(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = judge(b["text"], model)
            out.insert(0, "doc_id", b["doc_id"].to_numpy(object))
            yield out

    return map_by_id(docs.select("doc_id", "text"), run, STAT_SCHEMA + ", base_failed boolean, quality double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that the rules keep; no row
    is shuffled."""
    model = fit(docs, labels)

    @F.pandas_udf("boolean")
    def keeps(text: pd.Series) -> pd.Series:
        return judge(text, model)["kept"]

    return docs.where(keeps(F.col("text")))
