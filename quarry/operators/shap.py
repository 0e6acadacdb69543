"""Tree SHAP (H1): path-dependent SHAP values (Lundberg, Erion, Lee 2018;
Lundberg et al. 2020) of forests and boosted trees (``boost``; their values are
those of the margins), as a join of rows with root-to-leaf paths.

The ensemble's nodes become a table, and every leaf's path is reduced there to one
entry per input: the interval the path asks for and its share, the product of the
cover ratios along that input's splits. With o_j = 1 where a row's value lies in the
interval and z_j the share, the leaf's value v adds to input i

    v (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (z_j (1 - t) + o_j t)

(the Shapley weight s! (d - 1 - s)! / d! is that integral of t^s (1 - t)^(d - 1 - s)).
The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature on
ceil(d / 2) points is exact; all its factors are positive, so one product serves
every i by division. The integrals depend on a row only by which intervals hold it: a
short path's are taken once per such set (2^d, if there are as many rows) and looked up.

Rows are packed into blocks and paths into blocks of ``BLOCK_PATHS``; every row
block meets every path block through an equi-join on the path block and a salt (a
small model spreads over all tasks), and partial values are added up per row block.
Row blocks are sized by the number of path blocks, so that such a group stays within
``GROUP_BYTES``. The driver sees leaf counts per tree and path-block ids only.

``shap_gaps`` takes rows that no threshold of the ensemble tells apart once, with their
number: a table of any length has at most one such row per cell of the thresholds' grid.

Importance = mean |phi| per vector slot, averaged over the outputs of a
multi-output model. A table without complete rows gives no importance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.forest import equal_rows
from quarry.session import cut_lineage

BLOCK_PATHS = 8_192
BLOCK_ROWS = 4_096                  # most rows of a row block
GROUP_BYTES = 64 * 2**20            # partial values that meet per row block
TABLE_ENTRIES = 8                   # longest path whose values are looked up
TABLE_PATHS = 1_024                 # paths whose tables are held at once
CHUNK = 100_000                     # row-path pairs per numpy step (within cache)
NODES = "tree int, id int, left int, right int, feature int, threshold double, flip boolean, cover double, value array<double>"


# ------------------------------------------------------------------ node tables
def _boosted_nodes(spark, model: dict) -> tuple[DataFrame, int]:
    """Nodes of a boosted model, whose leaves point to themselves; the base is a tree of one leaf."""
    out, parts = len(model["base"]), []
    trees = [(t, k) for one_round in model["trees"] for k, t in enumerate(one_round)]
    trees += [({"feature": [0], "threshold": [0.0], "left": [0], "right": [0], "value": [v], "cover": [1.0]}, k)
              for k, v in enumerate(model["base"])]
    for number, (t, k) in enumerate(trees):
        ids = np.arange(len(t["left"]))
        leaf = np.asarray(t["left"]) == ids
        value = np.zeros((len(ids), out))
        value[:, k] = t["value"]
        # plain Python values: array values of a pandas frame need Arrow, which a session may have off
        parts += zip([number] * len(ids), ids.tolist(), np.where(leaf, -1, t["left"]).tolist(), np.where(leaf, -1, t["right"]).tolist(),
                     t["feature"], map(float, t["threshold"]), [False] * len(ids), map(float, t["cover"]), value.tolist(), strict=True)
    return spark.createDataFrame(parts, NODES), out


def _forest_nodes(spark, est, path: str, classes: int) -> DataFrame:
    """Nodes of a saved forest; values are shared out over its trees. The encoder
    makes no categorical slots but those of two values, so sets are intervals too."""
    est.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats, cut = F.col("impurityStats"), F.col("split.leftCategoriesOrThreshold")
    total = F.aggregate(stats, F.lit(0.0), lambda a, v: a + v)
    is_set = F.coalesce(F.col("split.numCategories") >= 0, F.lit(False))
    if classes:
        value, cover = F.transform(stats, lambda v: F.coalesce(F.try_divide(v, total), F.lit(0.0)) / est.getNumTrees), total
    else:
        value, cover = F.array(F.col("prediction") / est.getNumTrees), F.get(stats, F.lit(0))
    threshold = F.when(F.col("split.numCategories") > 2, F.raise_error(F.lit("a split on more than two categories")).cast("double")) \
        .when(is_set, F.lit(0.5)).otherwise(F.get(cut, F.lit(0)))
    return nodes.select(F.col("tree").cast("int"), F.col("id").cast("int"), F.col("leftChild").cast("int").alias("left"),
                        F.col("rightChild").cast("int").alias("right"), F.col("split.featureIndex").cast("int").alias("feature"),
                        threshold.alias("threshold"), (is_set & F.array_contains(cut, 1.0)).alias("flip"), cover.alias("cover"),
                        value.alias("value"))


def tree_nodes(spark, fitted) -> tuple[DataFrame, int]:
    """The ensemble as a table of nodes, and its number of outputs."""
    from quarry.sources.sinks import scratch_path
    est = fitted.pipeline.stages[-1]
    name = type(est).__name__
    if name == "BoostedTrees":
        return _boosted_nodes(spark, est.content)
    if name == "RandomForestClassificationModel":
        return _forest_nodes(spark, est, scratch_path(spark, "shap-model"), est.numClasses), est.numClasses
    if name == "RandomForestRegressionModel":
        return _forest_nodes(spark, est, scratch_path(spark, "shap-model"), 0), 1
    raise ValueError(f"not a tree ensemble: {name}")


# ------------------------------------------------------------------ paths
def paths_of(left, right, feature, threshold, flip, cover):
    """One tree's leaves and their paths: (leaf positions, entries per leaf, and
    feature, low, high, share as arrays leaves x longest path). A path's entries are
    its inputs in order, low < x <= high (NaN: no bound); the rest of its line is
    padding that asks for nothing and changes nothing."""
    parent, low_side = np.full(len(left), -1), np.zeros(len(left), bool)
    inner, leaves = np.flatnonzero(left >= 0), np.flatnonzero(left < 0)
    parent[left[inner]], parent[right[inner]] = inner, inner
    low_side[left[inner]], low_side[right[inner]] = ~flip[inner], flip[inner]
    steps, at, which = [], leaves, np.arange(len(leaves))
    while True:
        up = parent[at]
        at, which, up = at[up >= 0], which[up >= 0], up[up >= 0]
        if not len(at):
            break
        low = low_side[at]
        steps.append((which, feature[up], np.where(low, np.nan, threshold[up]), np.where(low, threshold[up], np.nan), cover[at] / cover[up]))
        at = up
    if not steps:
        none = np.zeros((len(leaves), 0))
        return leaves, np.zeros(len(leaves), int), none.astype(np.int32), none, none, none
    which, f, low, high, share = (np.concatenate(a) for a in zip(*steps, strict=True))
    order = np.lexsort((f, which))
    which, f, low, high, share = which[order], f[order], low[order], high[order], share[order]
    first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (f[1:] != f[:-1])))
    low, high, share = np.fmax.reduceat(low, first), np.fmin.reduceat(high, first), np.multiply.reduceat(share, first)
    which, f = which[first], f[first]
    length = np.bincount(which, minlength=len(leaves))
    place = np.arange(len(which)) - (np.cumsum(length) - length)[which]
    shape = (len(leaves), int(length.max()))

    def laid(values, rest, kind=float):
        a = np.full(shape, rest, kind)
        a[which, place] = values
        return a

    return leaves, length, laid(f, 0, np.int32), laid(low, np.nan), laid(high, np.nan), laid(share, 1.0)


def _packed(nodes: pd.DataFrame, size: int):
    """Path blocks of some whole trees: paths by length, so that a block holds little padding."""
    found = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("id")
        ids = t["id"].to_numpy()
        left, right = (np.where(t[c].fillna(-1) >= 0, np.searchsorted(ids, t[c].fillna(-1)), -1) for c in ("left", "right"))
        leaves, length, *arrays = paths_of(left, right, t["feature"].fillna(0).to_numpy(np.int32), t["threshold"].to_numpy(float),
                                           t["flip"].fillna(False).to_numpy(bool), t["cover"].to_numpy(float))
        found.append((length, *arrays, np.stack(t["value"].to_numpy())[leaves]))
    widest = max(a[1].shape[1] for a in found)

    def joined(i, rest):
        return np.concatenate([np.pad(a[i], ((0, 0), (0, widest - a[i].shape[1])), constant_values=rest) for a in found])

    length, value = np.concatenate([a[0] for a in found]), np.concatenate([a[5] for a in found])
    arrays = [joined(1, 0), joined(2, np.nan), joined(3, np.nan), joined(4, 1.0)]
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), size):
        pick = order[i:i + size]
        d = int(length[pick].max())
        yield [len(pick), d, *(np.ascontiguousarray(a[pick, :d]).tobytes() for a in arrays), value[pick].tobytes()]


def path_blocks(nodes: DataFrame) -> DataFrame:
    """(block, paths, longest, feature, low, high, share, value), checkpointed: whole
    trees are dealt to tasks by their leaf counts."""
    leaves = nodes.where(F.coalesce(F.col("left"), F.lit(-1)) < 0).groupBy("tree").count().orderBy("tree").collect()
    start, deal, size = 0, [], BLOCK_PATHS
    for r in leaves:
        deal.append((r["tree"], start // size))
        start += r["count"]
    dealt = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(deal, "tree int, part int")), "tree")

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        rows = [[f"{key[0]}:{i}", *r] for i, r in enumerate(_packed(b, size))]
        return pd.DataFrame(rows, columns=["block", "paths", "longest", "feature", "low", "high", "share", "value"])

    return cut_lineage(dealt.groupBy("part").applyInPandas(
        pack, "block string, paths int, longest int, feature binary, low binary, high binary, share binary, value binary"))


def _integrals(z, inside) -> list[np.ndarray]:
    """Per entry j of the paths its summand without the leaf's value, for shares ``z``
    (paths, d) and intervals ``inside`` (one array per entry, which broadcasts to them)."""
    d = z.shape[-1]
    t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
    total = [0.0] * d
    for tq, wq in zip((t + 1) / 2, w / 2, strict=True):
        factors = [z[..., j] * (1 - tq) + tq * inside[j] for j in range(d)]
        product = wq * factors[0]
        for g in factors[1:]:
            product = product * g
        for j in range(d):
            total[j] = total[j] + product / factors[j]
    return [total[j] * (inside[j] - z[..., j]) for j in range(d)]


def _looked_up(x, phi, feature, low, high, share, value) -> None:
    """Add to ``phi`` (inputs, outputs, rows) the values of paths of d entries, from a
    table by the set of intervals that hold a row; ``x`` is (inputs, rows)."""
    d = feature.shape[1]
    sets = np.arange(2**d)
    tables = _integrals(share[:, None, :], [(sets >> j & 1).astype(float)[None, :] for j in range(d)])
    for i in range(len(feature)):
        mask = np.zeros(x.shape[1], np.uint16)
        for j in range(d):
            column = x[feature[i, j]]
            held = ~(column <= low[i, j]) & ~(column > high[i, j])
            mask |= held.astype(np.uint16) << np.uint16(j)
        for j in range(d):
            s = tables[j][i].take(mask)
            for k in np.flatnonzero(value[i]):
                phi[feature[i, j], k] += s * value[i, k]


def path_values(x: np.ndarray, feature, low, high, share, value) -> np.ndarray:
    """phi (rows, inputs, outputs) that these paths add."""
    n, m = x.shape
    phi = np.zeros((n, m, value.shape[1]))
    if not feature.shape[1]:
        return phi
    # entries that ask for nothing end a path's line
    length = np.max(np.where(np.isnan(low) & np.isnan(high) & (share >= 1), 0, np.arange(1, feature.shape[1] + 1)), axis=1, initial=0)
    short = min(TABLE_ENTRIES, int(max(n, 1)).bit_length() - 1)
    columns, found = np.ascontiguousarray(x.T), np.zeros((m, value.shape[1], n))
    for d in range(1, short + 1):
        pick = np.flatnonzero(length == d)
        for i in range(0, len(pick), TABLE_PATHS):
            at = pick[i:i + TABLE_PATHS]
            _looked_up(columns, found, *(a[at, :d] for a in (feature, low, high, share)), value[at])
    phi += found.transpose(2, 0, 1)
    rest = length > short
    feature, low, high, share, value = (a[rest] for a in (feature, low, high, share, value))
    step = max(1, CHUNK // max(n, 1))
    for i in range(0, len(feature), step):
        f, lo, hi, z, v = (a[i:i + step] for a in (feature, low, high, share, value))
        d = int(length[rest][i:i + step].max())         # the rest is padding
        inside = [~(x[:, f[:, j]] <= lo[:, j]) & ~(x[:, f[:, j]] > hi[:, j]) for j in range(d)]
        for j, s in enumerate(_integrals(z[:, :d], inside)):
            order = np.argsort(f[:, j], kind="stable")
            inputs, first = np.unique(f[order, j], return_index=True)
            for k in range(value.shape[1]):
                phi[:, inputs, k] += np.add.reduceat((s * v[:, k])[:, order], first, axis=1)
    return phi


def unpacked(r, out: int):
    """The arrays of a path block."""
    shape = (r["paths"], r["longest"])
    return (np.frombuffer(r["feature"], np.int32).reshape(shape), *(np.frombuffer(r[c]).reshape(shape) for c in ("low", "high", "share")),
            np.frombuffer(r["value"]).reshape(r["paths"], out))


# ------------------------------------------------------------------ rows x paths
def feature_frame(fitted, df: DataFrame) -> DataFrame:
    """The assembled feature vector of every row, as an array column."""
    from pyspark.ml import PipelineModel
    prefix = PipelineModel(stages=fitted.pipeline.stages[:-1])
    return prefix.transform(df).select(vector_to_array("features").alias("x"))


def _row_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (x, y, times) in blocks, checkpointed: a repeated task must not cut them anew."""
    def pack(batches):
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i:i + size]
                yield pd.DataFrame({"n": [len(part)], "x": [np.stack(part["x"].to_numpy()).astype(float).tobytes()],
                                    "y": [part["y"].to_numpy(float).tobytes()], "times": [part["times"].to_numpy(np.int64).tobytes()]})

    packed = rows.mapInPandas(pack, "n int, x binary, y binary, times binary")
    return cut_lineage(packed.withColumn("rows", F.monotonically_increasing_id()))


def _told_apart(rows: DataFrame, nodes: DataFrame, m: int) -> DataFrame:
    """(x, y, times): the rows of (x, y) whose inputs lie between the same thresholds and
    whose y is the same as one row, each input as the threshold above it, and their number."""
    asked = nodes.where(F.coalesce(F.col("left"), F.lit(-1)) >= 0).select("feature", "threshold").distinct().toPandas()
    cuts = [np.sort(asked["threshold"].to_numpy(float)[asked["feature"].to_numpy() == j]) for j in range(m)]
    above = [np.append(c, [np.inf, np.nan]) for c in cuts]

    def gather(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_numpy()).astype(float)
            codes = [np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j])) for j, c in enumerate(cuts)]
            y, which = np.unique(b["y"].to_numpy(float), return_inverse=True)
            first, group = equal_rows(len(b), zip([*codes, which], [*map(len, above), len(y)], strict=True))
            x = np.stack([a[c[first]] for a, c in zip(above, codes, strict=True)], 1)
            yield pd.DataFrame({"x": list(x), "y": y[which[first]], "times": np.bincount(group)})

    return rows.mapInPandas(gather, "x array<double>, y double, times long").groupBy("x", "y").agg(F.sum("times").alias("times"))


def _per_block(rows: DataFrame, nodes: DataFrame, m: int, out: int, finish, schema: str) -> DataFrame:
    """``finish(phi, base, y, times)`` of every row block of rows (x, y, times), with phi
    (rows, inputs, outputs) and the outputs' expected values."""
    spark = rows.sparkSession
    paths = path_blocks(nodes)
    names = [r["block"] for r in paths.select("block").collect()]
    size = int(min(BLOCK_ROWS, max(16, GROUP_BYTES // (8 * m * out * max(len(names), 1)))))
    salts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(len(names), 1))
    left = _row_blocks(rows, size).withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(salts)).cast("int")) \
        .withColumn("block", F.explode(F.array(*[F.lit(v) for v in names])))
    right = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def values(batches):
        for b in batches:
            done = []
            for r in b.to_dict("records"):
                arrays = unpacked(r, out)
                phi = path_values(np.frombuffer(r["x"]).reshape(r["n"], m), *arrays)
                base = (arrays[4] * arrays[3].prod(axis=1)[:, None]).sum(axis=0)
                done.append((r["rows"], r["n"], phi.tobytes(), base.tobytes(), r["y"], r["times"]))
            yield pd.DataFrame(done, columns=["rows", "n", "phi", "base", "y", "times"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        phi = sum(np.frombuffer(v) for v in b["phi"]).reshape(int(b["n"].iloc[0]), m, out)
        return finish(phi, sum(np.frombuffer(v) for v in b["base"]), np.frombuffer(b["y"].iloc[0]), np.frombuffer(b["times"].iloc[0], np.int64))

    partial = left.join(right.hint("shuffle_merge"), ["block", "salt"]).mapInPandas(values, "rows long, n int, phi binary, base binary, y binary, times binary")
    return partial.groupBy("rows").applyInPandas(add, schema)


def shap_importance(fitted, df: DataFrame) -> DataFrame:
    """H1: (feature, importance) = mean |phi| per vector slot."""
    spark = df.sparkSession
    nodes, out = tree_nodes(spark, fitted)
    names = fitted.feature_names()
    m = len(names)
    rows = feature_frame(fitted, df.dropna(how="any", subset=list(fitted.inputs))).withColumns({"y": F.lit(0.0), "times": F.lit(1).cast("long")})

    def finish(phi, base, y, times):
        return pd.DataFrame({"slot": np.arange(m), "sabs": np.abs(phi).mean(axis=2).sum(axis=0), "n": len(y)})

    part = _per_block(rows, nodes, m, out, finish, "slot int, sabs double, n long")
    agg = part.groupBy("slot").agg((F.sum("sabs") / F.sum("n")).alias("importance"))
    lookup = spark.createDataFrame(list(enumerate(names)), "slot int, feature string")
    return agg.join(F.broadcast(lookup), "slot").select("feature", "importance")


def shap_gaps(fitted, df: DataFrame, tolerance: float) -> DataFrame:
    """(rows_off, n): rows whose SHAP values and base do not add up to the model's
    own prediction (of a class model: the last class's probability) within
    ``tolerance`` (relative), and all rows."""
    nodes, out = tree_nodes(df.sparkSession, fitted)
    m = len(fitted.feature_names())
    scored = fitted.pipeline.transform(df.dropna(how="any", subset=list(fitted.inputs)))
    margins = fitted.task == "classification" and fitted.kind != "rf"
    y = F.col("prediction") if fitted.task == "regression" else F.element_at(vector_to_array("probability"), -1)
    rows = scored.select(vector_to_array("features").alias("x"), y.alias("y"))

    def finish(phi, base, y, times):
        found = phi.sum(axis=1) + base
        if margins:         # of one output: the margin of the second of two classes
            e = np.exp(found - found.max(axis=1, keepdims=True)) if out > 1 else 1 / (1 + np.exp(-found))
            found = e / e.sum(axis=1, keepdims=True) if out > 1 else e
        gap = np.abs(found[:, -1] - y)
        return pd.DataFrame({"off": [int(times[gap > tolerance * np.maximum(1.0, np.abs(y))].sum())], "n": [int(times.sum())]})

    return _per_block(_told_apart(rows, nodes, m), nodes, m, out, finish, "off long, n long").agg(F.sum("off").alias("rows_off"), F.sum("n").alias("n"))
