"""Second-order gradient boosting (E6, E7, E13, E14): histogram trees on gradient
and hessian sums, with an L2 penalty on leaf values.

The inputs are cut into at most ``bins`` bins from a bounded hash sample
(``CUT_SAMPLE`` rows; where an input has no more values than bins there, every
value is a bin). Rows are dealt evenly to the cores (``session.spread``) and packed
once into blocks of bin numbers, labels and margins, which stay cached in their
tasks. A level of all trees of a round (one for
a regression or two classes, one per class under softmax) costs one job: each task
adds up gradient, hessian and row count per (tree, node, input, bin) over its
blocks, the sums are added up in a tree of tasks, and the driver picks every node's
split. Only the smaller child of a split is counted, its sibling is the parent less
it. What a task sends (cells with rows only) and the driver holds is bounded by the
model's parameters (nodes of a level x inputs x bins), never by the rows; sums of more
than ``DIRECT_TASKS`` tasks are merged by tasks first. Trees of the last rounds are
applied to a block as it is read; every ``SETTLE`` rounds their values go into the
margins, and every ``CUT``-th time these are checkpointed, so a lost executor costs a
few rounds at most.

A leaf's value is -G / (H + l2), scaled by the learning rate; a split must leave
``min_leaf`` rows and a hessian of ``min_hess`` on both sides and gain
GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2) > 0; of equals the first input and the
lowest bin. Rows with value <= the split's threshold go left.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir, spread

CUT_SAMPLE = 200_000        # rows from which the bins are drawn
BLOCK_ROWS = 16_384
TASK_ROWS = 32_768          # least rows of a task: one of a few rows is all overhead
SETTLE = 3                  # rounds whose trees wait before they enter the margins
CUT = 4                     # every so many times the margins are checkpointed
DIRECT_TASKS = 16           # up to so many tasks send their sums straight to the driver
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- one tree ------------------------------------------------------------------

def _leaf_of(tree: dict, b: np.ndarray) -> np.ndarray:
    """The node each row of bin numbers has reached (a leaf points to itself)."""
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(tree["depth"]):
        low = b[rows, tree["feature"][node]] <= tree["bin"][node]
        node = np.where(low, tree["left"][node], tree["right"][node])
    return node


class _Tree:
    """A growing tree: node lists, and the sums of its open nodes."""

    def __init__(self, columns: np.ndarray):
        self.feature, self.bin, self.left, self.right = [0], [0], [0], [0]
        self.value, self.cover, self.depth = [0.0], [0.0], 0
        self.columns = columns              # inputs this tree may split on
        self.open = [0]                     # nodes of the last level
        self.sums: dict[int, np.ndarray] = {}

    def asked(self) -> list[int]:
        """Nodes whose sums must be counted: the root, or of two siblings the smaller."""
        if self.open == [0]:
            return [0]
        return [min(pair, key=lambda x: (self.cover[x], x)) for pair in zip(self.open[::2], self.open[1::2], strict=True)]

    def arrays(self) -> dict:
        return {"feature": np.array(self.feature), "bin": np.array(self.bin), "left": np.array(self.left), "right": np.array(self.right),
                "depth": self.depth, "value": np.array(self.value), "cover": np.array(self.cover)}

    def count(self, found: dict[int, np.ndarray], parents: dict[int, np.ndarray], parent_of: dict[int, int]) -> None:
        self.sums = dict(found)
        for a, b in zip(self.open[::2], self.open[1::2], strict=False):
            small, large = (a, b) if a in found else (b, a)
            self.sums[large] = parents[parent_of[large]] - found[small]

    def split(self, p: dict) -> dict[int, int]:
        """Split every open node that gains; returns the children's parents."""
        parent_of, opened = {}, []
        for node in self.open:
            s = self.sums[node]                     # inputs x bins x (g, h, n)
            g, h, n = s[self.columns[0], :, 0].sum(), s[self.columns[0], :, 1].sum(), s[self.columns[0], :, 2].sum()
            if node == 0:
                self.value[0], self.cover[0] = _value(g, h, p), float(n)
            cum = np.cumsum(s, axis=1)[:, :-1]
            gl, hl, nl = cum[:, :, 0], cum[:, :, 1], cum[:, :, 2]
            gr, hr, nr = g - gl, h - hl, n - nl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl**2 / (hl + p["l2"]) + gr**2 / (hr + p["l2"]) - g**2 / (h + p["l2"])
            bad = (np.minimum(nl, nr) < max(p["min_leaf"], 1)) | (np.minimum(hl, hr) < p["min_hess"]) | ~np.isfinite(gain)
            bad |= ~np.isin(np.arange(len(s)), self.columns)[:, None]
            gain = np.where(bad, -np.inf, gain)
            # sums of floats differ in their last digits: of practically equal gains the first
            top = gain.max(initial=-np.inf)
            if not top > 1e-9 * max(g * g / (h + p["l2"] + 1e-300), 1e-12):
                continue
            f, k = np.unravel_index(int(np.flatnonzero((gain >= top * (1 - 1e-10)).ravel())[0]), gain.shape)
            a, b = len(self.feature), len(self.feature) + 1
            self.feature[node], self.bin[node], self.left[node], self.right[node] = int(f), int(k), a, b
            for child, (cg, ch, cn) in ((a, (gl[f, k], hl[f, k], nl[f, k])), (b, (gr[f, k], hr[f, k], nr[f, k]))):
                self.feature.append(0), self.bin.append(0), self.left.append(child), self.right.append(child)
                self.value.append(_value(cg, ch, p)), self.cover.append(float(cn))
                parent_of[child] = node
            opened += [a, b]
        self.depth += bool(opened)
        self.open = opened
        return parent_of


def _value(g: float, h: float, p: dict) -> float:
    return float(-g / (h + p["l2"]) * p["lr"]) if h + p["l2"] > 0 else 0.0


# ---- blocks --------------------------------------------------------------------

def _gradients(loss: str, margin: np.ndarray, y: np.ndarray, curve: float):
    """(gradient, hessian) arrays, rows x trees."""
    if loss == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if loss == "logistic":
        q = 1 / (1 + np.exp(-margin))
        return q - y[:, None], q * (1 - q)
    q = np.exp(margin - margin.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    return q - (y[:, None] == np.arange(margin.shape[1])), curve * q * (1 - q)


def _settled(block, trees: list[list[dict]]):
    """The block with the trees' values (rounds x trees) added to its margins."""
    b, y, margin, mark = block
    margin = margin.copy()
    for one_round in trees:
        for k, tree in enumerate(one_round):
            margin[:, k] += tree["value"][_leaf_of(tree, b)]
    return b, y, margin, mark


def _level_sums(blocks, state, loss: str, round_: int, p: dict, n_bins: int):
    """Sums of one task: the cells (of asked nodes of all trees x inputs x bins) that
    have rows, and their sums of gradient, hessian and rows."""
    pending, growing, asked = state
    total = None
    for block in blocks:
        b, y, margin, mark = _settled(block, pending)
        g, h = _gradients(loss, margin, y, p["curve"])
        if p["subsample"] < 1:
            with np.errstate(over="ignore"):
                r = (mark ^ np.uint64(p["seed"] & 0xFFFFFFFF)) * _MIX + np.uint64(round_ + 1) * np.uint64(0xD1B54A32D192ED03)
                r = (r ^ (r >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            kept = (r >> np.uint64(11)).astype(float) / 2.0**53 < p["subsample"]
        else:
            kept = np.ones(len(y), bool)
        d = b.shape[1]
        if total is None:
            total = np.zeros((sum(map(len, asked)), d, n_bins, 3))
        at = 0
        for k, tree in enumerate(growing):
            slot = np.full(len(tree["feature"]), -1)
            slot[asked[k]] = np.arange(len(asked[k]))
            place = slot[_leaf_of(tree, b)]
            rows = np.flatnonzero(kept & (place >= 0))
            size = len(asked[k]) * n_bins
            for j in range(d):
                cell = place[rows] * n_bins + b[rows, j]
                for i, w in enumerate((g[rows, k], h[rows, k], None)):
                    total[at:at + len(asked[k]), j, :, i] += np.bincount(cell, w, size).reshape(-1, n_bins)
            at += len(asked[k])
    if total is None:
        return []
    total = total.reshape(-1, 3)
    cells = np.flatnonzero(total[:, 2])
    return [(cells, total[cells])]


def _merged(a, b):
    """The sums of two tasks as one."""
    cells, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    total = np.zeros((len(cells), 3))
    for part, places in ((a[1], at[:len(a[0])]), (b[1], at[len(a[0]):])):
        total[places] += part
    return cells, total


def _cuts(data: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Per input the sorted thresholds between bins, from the hash sample."""
    if n > CUT_SAMPLE:
        one_of = -(-n // CUT_SAMPLE)
        data = data.where(F.pmod(F.xxhash64("x", "y"), F.lit(one_of)) == 0)
    x = np.stack(data.select("x").toPandas()["x"].to_numpy())
    out = []
    for v in x.T:
        values = np.unique(v)
        if len(values) > bins:
            values = np.unique(np.quantile(v, np.arange(1, bins) / bins, method="lower"))
            out.append(values)
        else:
            out.append(values[:-1])
    return out


def fit_boosted(df: DataFrame, loss: str, classes: int, rounds: int, lr: float, depth: int, l2: float, min_leaf: int = 1,
                min_hess: float = 1e-3, bins: int = 255, subsample: float = 1.0, colsample: float = 1.0, seed: int = 42,
                curve: float = 1.0) -> BoostedTrees:
    """The model of rows (``features`` vector, ``label``); ``loss`` is squared,
    logistic (labels 0, 1) or softmax (labels 0 ... classes - 1), whose hessian is
    taken ``curve`` times q (1 - q)."""
    spark = df.sparkSession
    p = {"lr": lr, "l2": l2, "min_leaf": min_leaf, "min_hess": min_hess, "subsample": subsample, "seed": int(seed), "curve": curve}
    bins = min(int(bins), 256)
    data = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).persist()
    counts = {r["y"] if loss != "squared" else 0.0: r for r in data.groupBy(*([] if loss == "squared" else ["y"])).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).collect()}
    n = sum(r["n"] for r in counts.values())
    if not n:
        raise ValueError("no rows to fit")
    share = np.array([counts[c]["n"] if c in counts else 0 for c in map(float, range(classes))]) / n if loss != "squared" else None
    if loss == "squared":
        base = np.array([counts[0.0]["m"]])
    elif loss == "logistic":
        q = np.clip(share[1], 1e-9, 1 - 1e-9)
        base = np.array([np.log(q / (1 - q))])
    else:
        base = np.log(np.clip(share, 1e-9, None))
    cuts = _cuts(data, n, bins)
    n_bins = max(len(c) for c in cuts) + 1
    width = len(cuts)

    def pack(rows):
        mixers = np.random.default_rng(5).integers(1, 2**63, width, dtype=np.uint64) | np.uint64(1)
        held: list = []

        def block():
            x, y = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8)
            with np.errstate(over="ignore"):
                mark = (b.astype(np.uint64) * mixers).sum(1, dtype=np.uint64) ^ (y.view(np.uint64) * _MIX)
            return b, y, np.repeat(base[None, :], len(y), 0), mark

        for r in rows:
            held.append(r)
            if len(held) == BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    checkpoint_dir(spark)
    blocks = spread(data, n, TASK_ROWS).rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = blocks.getNumPartitions()
    done: list[list[dict]] = []
    pending: list[list[dict]] = []
    cached = [blocks]
    n_trees = len(base)
    for round_ in range(rounds):
        rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, round_])
        take = max(1, round(colsample * width))
        trees = [_Tree(np.sort(rng.permutation(width)[:take]) if take < width else np.arange(width)) for _ in range(n_trees)]
        parents, parent_of = [{} for _ in trees], [{} for _ in trees]
        for _ in range(depth):
            asked = [t.asked() if t.open else [] for t in trees]
            if not any(asked):
                break
            state = pending, [t.arrays() for t in trees], asked      # ships with the tasks, as a closure does
            sums = blocks.mapPartitions(lambda it, s=state, r=round_: _level_sums(it, s, loss, r, p, n_bins))
            total = np.zeros((sum(map(len, asked)) * width * n_bins, 3))
            for cells, part in sums.collect() if tasks <= DIRECT_TASKS else [sums.treeReduce(_merged, depth=3)]:
                total[cells] += part
            total = total.reshape(-1, width, n_bins, 3)
            while len(cached) > 1:          # that job has made the newest blocks
                cached.pop(0).unpersist()
            at = 0
            for k, tree in enumerate(trees):
                found = dict(zip(asked[k], total[at:at + len(asked[k])], strict=True))
                at += len(asked[k])
                if tree.open:
                    tree.count(found, parents[k], parent_of[k])
                    parents[k], parent_of[k] = tree.sums, tree.split(p)
        pending.append([t.arrays() for t in trees])
        done.append(pending[-1])
        if len(pending) == SETTLE and round_ + 1 < rounds:
            blocks = blocks.map(lambda x, s=pending: _settled(x, s)).persist(StorageLevel.MEMORY_AND_DISK)
            if len(done) % (SETTLE * CUT) == 0:
                blocks.checkpoint()
            cached.append(blocks)
            pending = []
    for x in cached:
        x.unpersist()
    data.unpersist()
    model = {"loss": loss, "base": base.tolist(), "trees": [[_plain(t, cuts) for t in one_round] for one_round in done]}
    return BoostedTrees(model=json.dumps(model))


def _plain(tree: dict, cuts) -> dict:
    """A tree with thresholds in place of bin numbers, for JSON."""
    inner = tree["left"] != np.arange(len(tree["left"]))
    threshold = [float(cuts[f][b]) if i else 0.0 for f, b, i in zip(tree["feature"], tree["bin"], inner, strict=True)]
    return {"feature": tree["feature"].tolist(), "threshold": threshold, "left": tree["left"].tolist(), "right": tree["right"].tolist(),
            "value": tree["value"].tolist(), "cover": tree["cover"].tolist(), "depth": tree["depth"]}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """Rows x trees: the base and the leaves of all rounds."""
    out = np.repeat(np.array(model["base"])[None, :], len(x), 0)
    rows = np.arange(len(x))
    for one_round in model["trees"]:
        for k, t in enumerate(one_round):
            feature, threshold, left, right = (np.array(t[c]) for c in ("feature", "threshold", "left", "right"))
            node = np.zeros(len(x), np.int64)
            for _ in range(t["depth"]):
                low = x[rows, feature[node]] <= threshold[node]
                node = np.where(low, left[node], right[node])
            out[:, k] += np.array(t["value"])[node]
    return out


class BoostedTrees(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted ensemble as a pipeline stage; it is saved as its JSON text."""

    model = Param(Params._dummy(), "model", "loss, base and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, model="{}"):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    @property
    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.model))

    def _transform(self, df):
        shared = df.sparkSession.sparkContext.broadcast(self.content)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(col: pd.Series) -> pd.Series:
            m = margins(shared.value, np.stack(col.to_numpy())) if len(col) else np.zeros((0, 1))
            if shared.value["loss"] == "logistic":
                q = 1 / (1 + np.exp(-m[:, 0]))
                m = np.stack([1 - q, q], 1)
            elif shared.value["loss"] == "softmax":
                m = np.exp(m - m.max(1, keepdims=True))
                m /= m.sum(1, keepdims=True)
            return pd.Series(list(m), dtype=object)

        out, kind = self.getOrDefault(self.predictionCol), self.content["loss"]
        scored = df.withColumn("__score", score(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))
        if kind == "squared":
            return scored.withColumn(out, F.col("__score")[0]).drop("__score")
        best = F.array_position("__score", F.array_max("__score")) - 1
        return (scored.withColumn("probability", array_to_vector(F.col("__score")))
                .withColumn(out, best.cast("double")).drop("__score"))
