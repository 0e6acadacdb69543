"""Random forests (E5, E12): bagged trees grown to a least leaf size, with MLlib's
parameters, gains and saved form (so a fitted forest is an MLlib model).

MLlib's learner sums a dense table of (input, bin, statistic) for every node of every
tree, which for forests of a million small nodes is most of its work. Here the inputs
are cut into bins once, and a row is kept as the cells (input, bin) in which it differs
from each input's most frequent bin; what is not listed follows by subtraction from the
node's total. A table of one-hot inputs has a few cells a row. No tree tells rows of the
same cells (and class) apart, so a bag holds them once, with their number and sums.

  1. Rows are dealt evenly to the cores and packed into one block a task.
  2. If that made the bags much smaller than the table but not small enough for a task,
     the bags of all blocks are added up and kept.
  3. Nodes of more than ``LOCAL_CELLS`` cells are split level by level: tasks sum up
     (tree, node, cell), a group per node picks the split, the driver holds these
     top splits only (at most cells / ``LOCAL_CELLS`` nodes a tree and level).
  4. The rows of every node below are sent to one task, which grows its subtree.

A large forest over a few inputs scores a table's cells, the rows between the same
thresholds, once each (``scored``); MLlib's model follows pointers through all trees for every row.

A bag is drawn per (block, tree) from the seed, so a repeated task draws it again.
A split must leave ``leaf`` rows (bag counts) on both sides and gain; of practically
equal gains the first input and the lowest bin. Of a class forest, leaves that agree
with their sibling are merged with it, as MLlib does.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir, cut_lineage

CUT_SAMPLE = 65_536         # rows from which the bins are drawn
LEAST_ROWS = 8_192          # least rows of a task
BLOCK_CELLS = 8_000_000     # about the most cells of a block
LOCAL_CELLS = 2_000_000     # cells of a node that one task finishes
GRID_CELLS = 1_000_000      # most cells between all inputs' thresholds that are scored as such
LARGE_NODES = 100_000       # least nodes of such a forest
POOLED_SHARE = 4            # bags this many times smaller than the table are kept


def equal_rows(n: int, columns) -> tuple[np.ndarray, np.ndarray]:
    """The first of every group of equal ones of ``n`` rows, and each row's group, by
    columns (numbers from 0 to size - 1, size)."""
    key, span = np.zeros(n, np.int64), 1
    for numbers, size in columns:
        if span > 2**62 // size:
            key, span = np.unique(key, return_inverse=True)[1], n
        key, span = key * size + numbers, span * size
    if span > 4 * len(key) + 1_000_000:
        return np.unique(key, return_index=True, return_inverse=True)[1:]
    there = np.zeros(span, bool)
    there[key] = True
    group = (np.cumsum(there) - 1)[key]
    first = np.zeros(int(there.sum()), np.int64)
    first[group[::-1]] = np.arange(len(key) - 1, -1, -1)
    return first, group


class Bins:
    """The inputs' thresholds, and one number per (input, bin): its cell."""

    def __init__(self, sample: np.ndarray, bins: int):
        self.cuts = []
        for v in sample.T:
            values = np.unique(v)
            last = values[:-1] if len(values) <= bins else np.unique(np.quantile(v, np.arange(1, bins) / bins, method="lower"))
            last = last[last < values[-1]]
            after = values[np.searchsorted(values, last, side="right")]
            middle = last / 2 + after / 2
            self.cuts.append(np.where((middle >= last) & (middle < after), middle, last))
        sizes = np.array([len(c) + 1 for c in self.cuts])
        self.start = np.cumsum(sizes) - sizes
        self.cells = int(sizes.sum())
        self.input_of = np.repeat(np.arange(len(sizes)), sizes)
        found = self.numbers(sample)
        self.usual = np.array([s + np.bincount(c - s).argmax() for s, c in zip(self.start, found.T, strict=True)])
        self.per_row = max(1.0, float((found != self.usual).sum(1).mean()))

    def numbers(self, x: np.ndarray) -> np.ndarray:
        return np.stack([s + np.searchsorted(c, x[:, j], side="left") for j, (s, c) in enumerate(zip(self.start, self.cuts, strict=True))], 1)

    def threshold(self, cell: np.ndarray) -> np.ndarray:
        flat = np.concatenate([np.append(c, np.inf) for c in self.cuts])
        return flat[cell]


class Rows:
    """Rows as cells that differ from the usual ones, with labels and bag counts. A row
    that stands for several has their mean label, and ``yy``, the sum of its squares."""

    def __init__(self, length, cell, y, w, yy=None):
        self.length, self.cell, self.y, self.w, self.yy = length, cell, y, w, yy
        self.row = np.repeat(np.arange(len(length)), length)

    def where(self, keep: np.ndarray) -> Rows:
        return Rows(self.length[keep], self.cell[np.repeat(keep, self.length)], self.y[keep], self.w[keep], None if self.yy is None else self.yy[keep])

    def equal(self, cells: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of every group of rows of the same cells and class, and each row's group."""
        def columns():
            start = np.cumsum(self.length) - self.length
            for k in range(int(self.length.max(initial=0))):
                has, numbers = np.flatnonzero(self.length > k), np.zeros(len(start), np.int64)
                numbers[has] = self.cell[start[has] + k] + 1
                yield numbers, cells + 1
            if classes:
                yield self.y.astype(np.int64), classes

        return equal_rows(len(self.length), columns())

    def together(self, cells: int, classes: int) -> Rows:
        """Rows of the same cells and class as one."""
        first, group = self.equal(cells, classes)
        if len(first) == len(group):
            return self
        one = self.where(_marked(first, len(group)))
        order = group[np.sort(first)]                   # ``where`` keeps the rows' order
        one.w = np.bincount(group, self.w)[order]
        if not classes:
            one.y = np.bincount(group, self.w * self.y)[order] / one.w
            one.yy = np.bincount(group, self.w * self.y * self.y if self.yy is None else self.yy)[order]
        return one


def _marked(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places] = True
    return out


def _totals(at, size: int, rows: Rows, pick, classes: int, moments: int) -> np.ndarray:
    """Sums of the statistics per place: counts per class, or 1, y (and y * y)."""
    w, y = rows.w[pick].astype(float), rows.y[pick]
    if classes:
        return np.bincount(at * classes + y.astype(np.int64), w, size * classes).reshape(size, classes)
    parts = [w, w * y, *([w * y * y if rows.yy is None else rows.yy[pick]] if moments > 2 else [])]
    return np.stack([np.bincount(at, v, size) for v in parts], 1)


def _sums(at: np.ndarray, nodes: int, rows: Rows, cells: int, classes: int):
    """Node totals, and the (node, cell) pairs that have rows with their sums."""
    every = slice(None)
    total = _totals(at, nodes, rows, every, classes, 3)
    key = at[rows.row] * cells + rows.cell
    if nodes * cells <= 4 * len(key) + 1_000_000:
        there = np.zeros(nodes * cells, bool)
        there[key] = True
        keys, place = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
    else:
        keys, place = np.unique(key, return_inverse=True)
    return total, keys, _totals(place, len(keys), rows, rows.row, classes, 2)


def _allowed(seed: int, tree: int, heap: np.ndarray, inputs: int, take: int) -> np.ndarray:
    """Each node's inputs: the ``take`` least hashes of (seed, tree, node, input)."""
    with np.errstate(over="ignore"):
        r = heap.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, inputs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        r += np.uint64(tree + 1) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(0xE7037ED1A0B428DB)
        for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            r = (r ^ (r >> np.uint64(shift))) * np.uint64(mix)
        r ^= r >> np.uint64(31)
    out = np.zeros(r.shape, bool)
    np.put_along_axis(out, np.argpartition(r, take - 1, axis=1)[:, :take], True, axis=1)
    return out


def _size(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(-1) if classes else stats[..., 0]


def _squares(stats: np.ndarray, classes: int) -> np.ndarray:
    """Sum of squares over the count: its rise is the gain times the rows."""
    top = (stats**2).sum(-1) if classes else stats[..., 1] ** 2
    return top / np.maximum(_size(stats, classes), 1e-300)


def _rest(total: np.ndarray, classes: int) -> np.ndarray:
    """A node's impurity times its rows."""
    return (_size(total, classes) if classes else total[..., 2]) - _squares(total, classes)


def _best(total, keys, sums, heap, tree: int, bins: Bins, p: dict):
    """Per node the cell up to which rows go left (-1: a leaf) and the rows there."""
    classes, found = p["classes"], np.full(len(total), -1)
    left_rows = np.zeros(len(total))
    node, inputs = keys // bins.cells, bins.input_of[keys % bins.cells]
    able = (_size(total, classes) >= 2 * p["leaf"]) & (_rest(total, classes) > 1e-10 * np.abs(_size(total, classes) if classes else total[:, 2]))
    able &= heap < 2 ** p["depth"]
    keep = able[node]
    if p["take"] < len(bins.cuts):
        keep &= _allowed(p["seed"], tree, heap, len(bins.cuts), p["take"])[node, inputs]
    keys, sums, node, inputs = keys[keep], sums[keep], node[keep], inputs[keep]
    if not len(keys):
        return found, left_rows
    # the usual cell of each (node, input) is what the others leave
    head = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (inputs[1:] != inputs[:-1])))
    usual = total[node[head]][:, :sums.shape[1]] - np.add.reduceat(sums, head)
    more = _size(usual, classes) > 0.5
    keys = np.concatenate([keys, (node[head] * bins.cells + bins.usual[inputs[head]])[more]])
    sums = np.concatenate([sums, usual[more]])
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    node, inputs = keys // bins.cells, bins.input_of[keys % bins.cells]
    head = np.append(True, (node[1:] != node[:-1]) | (inputs[1:] != inputs[:-1]))
    run = np.cumsum(sums, axis=0)
    before = np.concatenate([np.zeros((1, sums.shape[1])), run[:-1]])[np.flatnonzero(head)]
    low = run - before[np.cumsum(head) - 1]
    high = total[node][:, :sums.shape[1]] - low
    gain = _squares(low, classes) + _squares(high, classes) - _squares(total[node], classes)
    gain[np.minimum(_size(low, classes), _size(high, classes)) < p["leaf"] - 0.5] = -np.inf
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    top, scale = np.maximum.reduceat(gain, first), _rest(total[node[first]], classes)
    good = top > 1e-10 * scale
    width = np.diff(np.append(first, len(node)))
    hit = np.flatnonzero(gain >= np.repeat(np.where(good, top - 1e-10 * scale, np.inf), width))
    at, which = np.unique(node[hit], return_index=True)
    found[at] = keys[hit[which]] % bins.cells
    left_rows[at] = _size(low[hit[which]], classes)
    return found, left_rows


def _goes_left(at, cell, rows: Rows, bins: Bins) -> np.ndarray:
    """Whether each row of a split node ``at`` lies in its left child."""
    split = cell[at]
    asked = bins.input_of[split]
    left = bins.usual[asked] <= split
    own = np.flatnonzero(bins.input_of[rows.cell] == asked[rows.row])
    left[rows.row[own]] = rows.cell[own] <= split[rows.row[own]]
    return left


def grow(rows: Rows, root: int, tree: int, bins: Bins, p: dict):
    """(heap number, cell or -1, totals) of all nodes of the subtree at ``root``."""
    out, heap, at = [], np.array([root], np.int64), np.zeros(len(rows.y), np.int64)
    while len(heap):
        total, keys, sums = _sums(at, len(heap), rows, bins.cells, p["classes"])
        cell, _ = _best(total, keys, sums, heap, tree, bins, p)
        out.append((heap, cell, total))
        inner = np.flatnonzero(cell >= 0)
        keep = (cell >= 0)[at]
        rows, at = rows.where(keep), at[keep]
        if not len(inner):
            break
        right = ~_goes_left(at, cell, rows, bins)
        slot = np.zeros(len(heap), np.int64)
        slot[inner] = np.arange(len(inner))
        at = 2 * slot[at] + right
        heap = np.stack([2 * heap[inner], 2 * heap[inner] + 1], 1).ravel()
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


# ---- on Spark ----------------------------------------------------------------------

_ROWS = "length binary, cell binary, y binary, w binary, yy binary"
_KINDS = {"length": np.int32, "cell": np.int32, "y": float, "w": np.int32, "yy": float}


def _sent(rows: Rows) -> list[bytes]:
    """The columns ``_ROWS`` of these rows."""
    return [b"" if v is None else np.asarray(v).astype(kind).tobytes()
            for v, kind in ((getattr(rows, c), kind) for c, kind in _KINDS.items())]


def _received(parts: list[dict]) -> Rows:
    """The rows of these columns ``_ROWS``."""
    got = [np.concatenate([np.frombuffer(r[c], kind) for r in parts]) for c, kind in _KINDS.items()]
    return Rows(*got[:4], got[4] if len(got[4]) else None)


def _blocks(data: DataFrame, bins: Bins, classes: int, mean: float) -> DataFrame:
    """One row a task: the different rows' cells (and classes), which of them each row is,
    and the rows' labels. Checkpointed, so blocks keep their numbers."""
    def pack(batches):
        found = []
        for b in batches:
            if b.num_rows:
                cells = bins.numbers(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                other = cells != bins.usual
                found.append((other.sum(1).astype(np.int32), cells[other].astype(np.int32), b.column("y").to_numpy(zero_copy_only=False) - mean))
        if found:
            length, cell, y = (np.concatenate(a) for a in zip(*found, strict=True))
            rows = Rows(length, cell, y, np.ones(len(y), np.uint8))
            first, group = rows.equal(bins.cells, classes)
            one = rows.where(_marked(first, len(group)))
            rank = np.empty(len(first), np.int32)
            rank[np.argsort(first)] = np.arange(len(first))
            label = (one.y, []) if classes else ([], rows.y)
            made = pd.DataFrame([[len(first), one.length.tobytes(), one.cell.tobytes(), *(np.asarray(v, float).tobytes() for v in label),
                                  rank[group].tobytes()]], columns=["rows", "length", "cell", "class", "y", "which"])
            yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    packed = data.mapInArrow(pack, "rows long, length binary, cell binary, class binary, y binary, which binary")
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


def _bags(batches, p: dict):
    """(tree, rows of its bag) of every block, or of every part of kept bags."""
    for b in batches:
        for r in b.to_dict("records"):
            if "tree" in r:
                yield r["tree"], _received([r])
                continue
            length, cell, y = np.frombuffer(r["length"], np.int32), np.frombuffer(r["cell"], np.int32), np.frombuffer(r["y"])
            which, size = np.frombuffer(r["which"], np.int32), int(r["rows"])
            for tree in range(p["trees"]):
                w = np.ones(len(which), np.uint8)
                if p["bootstrap"]:
                    rng = np.random.default_rng([p["seed"] & 0xFFFFFFFF, int(r["block"]), tree])
                    w = rng.poisson(1.0, len(which)).astype(np.uint8)
                    while not w.any():          # a table of a few rows: a bag is not empty
                        w = rng.poisson(1.0, len(which)).astype(np.uint8)
                times = np.bincount(which, w, size)
                if p["classes"]:
                    yield tree, Rows(length, cell, np.frombuffer(r["class"]), times).where(times > 0)
                else:
                    sums, squares = np.bincount(which, w * y, size), np.bincount(which, w * y * y, size)
                    yield tree, Rows(length, cell, sums / np.maximum(times, 1), times, squares).where(times > 0)


def _pooled(blocks: DataFrame, parts: int, bins: Bins, p: dict) -> DataFrame:
    """(tree, rows, their number) of the bags of all blocks together, in ``parts`` parts, kept."""
    def deal(batches):
        for tree, rows in _bags(batches, p):
            # a part by the row's cells and class
            part = np.bincount(rows.row, (rows.cell.astype(np.int64) * 0x9E3779B1 >> 7) & 0xFFFFFF, len(rows.y)).astype(np.int64)
            part = (part + (rows.y.astype(np.int64) if p["classes"] else 0)) % parts
            held = [(i, rows.where(part == i)) for i in range(parts)]
            yield pd.DataFrame([(tree, i, *_sent(r)) for i, r in held if len(r.y)], columns=["tree", "part", *_KINDS])

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        rows = _received(b.to_dict("records")).together(bins.cells, p["classes"])
        return pd.DataFrame([(key[0], len(rows.y), *_sent(rows))], columns=["tree", "rows", *_KINDS])

    dealt = blocks.mapInPandas(deal, f"tree int, part int, {_ROWS}").repartition(min(parts * p["trees"], 10_000), "tree", "part")
    return cut_lineage(dealt.groupBy("tree", "part").applyInPandas(add, f"tree int, rows long, {_ROWS}"))


def _walked(rows: Rows, splits: dict[int, int], bins: Bins) -> np.ndarray:
    """The heap number of each row's node below the top splits of its tree."""
    heap = np.ones(len(rows.y), np.int64)
    active = np.arange(len(rows.y))
    ids = np.array(sorted(splits), np.int64)
    cells = np.array([splits[i] for i in ids], np.int64)
    part = rows
    while len(active) and len(ids):
        place = np.minimum(np.searchsorted(ids, heap[active]), len(ids) - 1)
        inner = ids[place] == heap[active]
        if not inner.all():
            part = part.where(inner)
        active, place = active[inner], place[inner]
        heap[active] = 2 * heap[active] + ~_goes_left(place, cells, part, bins)
    return heap


def _top(blocks: DataFrame, large: bool, bins: Bins, p: dict) -> tuple[list[dict], list]:
    """Splits of the nodes too large for a task, per tree {heap number: cell}, and
    those nodes' (tree, heap, cell, totals); none if a task holds a tree (not ``large``)."""
    splits: list[dict] = [{} for _ in range(p["trees"])]
    limit = max(2 * p["leaf"], LOCAL_CELLS / bins.per_row)
    open_ = {t: [1] for t in range(p["trees"])} if large else {}
    nodes = []
    while open_:
        def level(batches, splits=splits, open_=open_):
            for tree, rows in _bags(batches, p):
                if tree not in open_ or not len(rows.y):
                    continue
                heap = _walked(rows, splits[tree], bins)
                ids = np.array(sorted(open_[tree]), np.int64)
                place = np.minimum(np.searchsorted(ids, heap), len(ids) - 1)
                here = ids[place] == heap
                if not here.any():
                    continue
                total, keys, sums = _sums(place[here], len(ids), rows.where(here), bins.cells, p["classes"])
                ends = np.searchsorted(keys, np.arange(len(ids) + 1) * bins.cells)
                yield pd.DataFrame([(tree, i, (keys[a:b] % bins.cells).tobytes(), sums[a:b].tobytes(), t.tobytes())
                                    for i, a, b, t in zip(ids, ends[:-1], ends[1:], total, strict=True)],
                                   columns=["tree", "heap", "cells", "sums", "total"])

        def choose(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            width = p["classes"] or 2
            total = sum(np.frombuffer(t) for t in b["total"])[None, :]
            dense, there = np.zeros((bins.cells, width)), np.zeros(bins.cells, bool)
            for cells, sums in zip(b["cells"], b["sums"], strict=True):
                at = np.frombuffer(cells, np.int64)
                dense[at] += np.frombuffer(sums).reshape(-1, width)
                there[at] = True
            keys = np.flatnonzero(there)
            cell, low = _best(total, keys, dense[keys], np.array([key[1]], np.int64), key[0], bins, p)
            return pd.DataFrame({"tree": [key[0]], "heap": [key[1]], "cell": cell, "low": low, "stats": [total[0].tolist()]})

        found = blocks.mapInPandas(level, "tree int, heap long, cells binary, sums binary, total binary") \
            .groupBy("tree", "heap").applyInPandas(choose, "tree int, heap long, cell int, low double, stats array<double>").collect()
        open_ = {}
        for r in found:
            nodes.append((r["tree"], r["heap"], r["cell"], list(r["stats"])))
            if r["cell"] < 0:
                continue
            splits[r["tree"]][r["heap"]] = r["cell"]
            size = sum(r["stats"]) if p["classes"] else r["stats"][0]
            for child, rows in ((2 * r["heap"], r["low"]), (2 * r["heap"] + 1, size - r["low"])):
                if rows > limit:
                    open_.setdefault(r["tree"], []).append(child)
    return splits, nodes


_NODE = "tree int, heap long, cell int, stats array<double>"


def _subtrees(blocks: DataFrame, splits: list[dict], done: list, groups: int, bins: Bins, p: dict) -> DataFrame:
    """Nodes below the top ones: a group per subtree."""
    ended = {(t, h) for t, h, cell, _ in done if cell < 0}

    def deal(batches):
        for tree, rows in _bags(batches, p):
            heap = _walked(rows, splits[tree], bins)
            out = []
            for h in np.unique(heap):
                if (tree, int(h)) not in ended:
                    out.append((tree, h, *_sent(rows.where(heap == h))))
            yield pd.DataFrame(out, columns=["tree", "heap", *_KINDS])

    def finish(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        rows = _received(b.to_dict("records")).together(bins.cells, p["classes"])
        heap, cell, total = grow(rows, key[1], key[0], bins, p)
        return pd.DataFrame({"tree": np.int32(key[0]), "heap": heap, "cell": cell.astype(np.int32), "stats": pd.Series(list(total), dtype=object)})

    dealt = blocks.mapInPandas(deal, f"tree int, heap long, {_ROWS}")
    return dealt.repartition(max(1, min(groups, 10_000)), "tree", "heap").groupBy("tree", "heap").applyInPandas(finish, _NODE)


def _merged_leaves(heap, cell, stats) -> np.ndarray:
    """Which nodes remain after leaves of one class have been merged upwards."""
    alive, cell = np.ones(len(heap), bool), cell.copy()
    vote = stats.argmax(1)
    for level in range(int(heap.max()).bit_length(), 0, -1):
        at = np.flatnonzero((heap >> (level - 1) == 1) & (cell >= 0))
        a, b = np.searchsorted(heap, 2 * heap[at]), np.searchsorted(heap, 2 * heap[at] + 1)
        same = (cell[a] < 0) & (cell[b] < 0) & (vote[a] == vote[b])
        alive[a[same]], alive[b[same]] = False, False
        cell[at[same]] = -1
    return alive


def _saved_form(nodes: DataFrame, bins: Bins, classes: int, mean: float) -> DataFrame:
    """The nodes as MLlib saves them: numbered within their tree, parents first."""
    def lay(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("heap")
        heap, cell, stats = b["heap"].to_numpy(np.int64), b["cell"].to_numpy(np.int64), np.stack(b["stats"].to_numpy())
        if classes:
            alive = _merged_leaves(heap, cell, stats)
            heap, cell, stats = heap[alive], cell[alive], stats[alive]
        left = np.searchsorted(heap, 2 * heap)
        inner = (cell >= 0) & (left < len(heap)) & (heap[np.minimum(left, len(heap) - 1)] == 2 * heap)
        left = np.where(inner, left, -1)
        right = np.where(inner, np.searchsorted(heap, 2 * heap + 1), -1)
        size, rest = _size(stats, classes), np.maximum(_rest(stats, classes), 0.0)
        safe = np.maximum(size, 1e-300)
        gain = np.where(inner, (rest - rest[left] - rest[right]) / safe, -1.0)
        if classes:
            prediction = stats.argmax(1).astype(float)
        else:
            prediction = stats[:, 1] / safe + mean
            n, s, ss = stats.T
            stats = np.stack([n, s + n * mean, ss + 2 * mean * s + n * mean * mean], 1)
        return pd.DataFrame({"tree": np.int32(key[0]), "id": np.arange(len(heap), dtype=np.int32), "prediction": prediction, "impurity": rest / safe,
                             "stats": pd.Series(list(stats), dtype=object), "n": size.round().astype(np.int64), "gain": gain,
                             "left": left.astype(np.int32), "right": right.astype(np.int32),
                             "feature": np.where(inner, bins.input_of[cell], -1).astype(np.int32), "cut": np.where(inner, bins.threshold(cell), 0.0)})

    flat = nodes.groupBy("tree").applyInPandas(lay, "tree int, id int, prediction double, impurity double, stats array<double>, n long, gain double, "
                                                    "left int, right int, feature int, cut double")
    cut = F.when(F.col("feature") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), cut.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    return flat.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split")).alias("nodeData"))


def fit_forest(df: DataFrame, est, n: int, classes: int):
    """The MLlib model of the forest that the MLlib estimator ``est`` describes, from
    the ``n`` rows (``features`` vector, ``label``) of ``df``."""
    from quarry.sources.sinks import scratch_path
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not n:
        raise ValueError("no rows to fit")
    width = len(df.select("features").first()["features"])
    tasks = max(1, min(-(-n // LEAST_ROWS), max(spark.sparkContext.defaultParallelism, -(-n * min(width, 64) // BLOCK_CELLS))))
    held = df.select("features", "label").repartition(tasks).persist()
    data = held.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    mean = 0.0 if classes else float(data.agg(F.avg("y")).first()[0])
    sample = data if n <= CUT_SAMPLE else data.sample(CUT_SAMPLE / n, seed=est.getSeed())
    bins = Bins(np.stack(sample.select("x").toPandas()["x"].to_numpy()), est.getMaxBins())
    take = width if est.getFeatureSubsetStrategy() == "all" else max(1, int(np.ceil(np.sqrt(width))))
    p = {"classes": classes, "trees": est.getNumTrees(), "depth": est.getMaxDepth(), "leaf": est.getMinInstancesPerNode(),
         "bootstrap": est.getBootstrap(), "take": take, "seed": int(est.getSeed())}
    blocks = _blocks(data, bins, classes, mean)
    held.unpersist()
    # a bag holds no more rows than the blocks' different ones, nor, added up, than there are ways to be different
    listed = blocks.agg(F.sum("rows")).first()[0]
    most = min(listed, math.prod(len(c) + 1 for c in bins.cuts) * max(classes, 1))
    large = most * bins.per_row > LOCAL_CELLS
    if (large or listed * bins.per_row > BLOCK_CELLS) and listed * POOLED_SHARE <= n:
        blocks = _pooled(blocks, math.ceil(listed * bins.per_row / LOCAL_CELLS), bins, p)
        most = blocks.groupBy("tree").agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0]
        large = most * bins.per_row > LOCAL_CELLS
    else:
        large |= listed * bins.per_row > BLOCK_CELLS
    splits, done = _top(blocks, large, bins, p)
    groups = sum(len(s) + 1 for s in splits)
    nodes = _subtrees(blocks, splits, done, groups, bins, p)
    if done:
        nodes = nodes.unionByName(spark.createDataFrame(done, _NODE))
    # a forest of bare roots brings the metadata that MLlib saves beside the nodes
    rows = [(float(c), Vectors.sparse(width, {})) for c in range(max(classes, 2))]
    bare = est.fit(spark.createDataFrame(rows, T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])))
    path = scratch_path(spark, "forest")
    bare.write().overwrite().save(path)
    _saved_form(nodes, bins, classes, mean).write.mode("overwrite").parquet(f"{path}/data")
    model = type(bare).load(path)
    model.cuts = bins.cuts
    return model


def scored(df: DataFrame, est) -> DataFrame:
    """``est.transform(df)`` of a forest of ``fit_forest``. A large one predicts each cell
    between its thresholds once; the rows take their cell's prediction."""
    cuts = getattr(est, "cuts", None)
    if cuts is None or df.isStreaming or est.totalNumNodes < LARGE_NODES or math.prod(len(c) + 2 for c in cuts) > GRID_CELLS:
        return est.transform(df)
    above = [np.append(c, [np.inf, np.nan]) for c in cuts]

    @F.pandas_udf("long")
    def numbered(v: pd.Series) -> pd.Series:
        x, cell = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(cuts))), np.zeros(len(v), np.int64)
        for j, c in enumerate(cuts):
            cell = cell * (len(c) + 2) + np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j]))
        return pd.Series(cell)

    @F.pandas_udf("array<double>")
    def inputs(v: pd.Series) -> pd.Series:
        cell, x = v.to_numpy(np.int64), np.zeros((len(v), len(cuts)))
        for j in reversed(range(len(cuts))):
            cell, at = np.divmod(cell, len(above[j]))
            x[:, j] = above[j][at]
        return pd.Series(list(x))

    rows = df.withColumn("__cell", numbered(vector_to_array("features")))
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    cells = rows.select("__cell").distinct().repartition(tasks).sortWithinPartitions("__cell")
    # a missing input (NaN) comes back from pandas as NULL
    x = F.transform(inputs("__cell"), lambda v: F.coalesce(v, F.lit(float("nan"))))
    found = est.transform(cells.withColumn("features", array_to_vector(x))).drop("features")
    return rows.join(found, "__cell", "left").drop("__cell")
