import math

import numpy as np
import pandas as pd
import pytest

from quarry.operators import knn


def _frame(spark, x, id_name, labels=None):
    rows = [(i, v.tolist(), float(labels[i]) if labels is not None else 0.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"{id_name} long, v array<double>, label double")
    return df if labels is not None else df.drop("label")


def _brute(x, q, k):
    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))
    return [[(j, row[j]) for j in np.lexsort((np.arange(len(x)), row))[:k]] for row in d]


CASES = {
    "2 inputs": lambda r: r.standard_normal((600, 2)),
    "5 inputs": lambda r: r.standard_normal((600, 5)),
    "8 inputs": lambda r: r.standard_normal((600, 8)),
    "skewed": lambda r: np.stack([np.minimum(r.zipf(1.6, 600), 500), r.integers(0, 3, 600)], 1).astype(float),
    "hot value": lambda r: np.concatenate([np.zeros((250, 3)), r.standard_normal((350, 3))]),
    "first two useless": lambda r: np.concatenate([np.ones((600, 2)), r.standard_normal((600, 3))], 1),
}


@pytest.mark.parametrize("block", [20_000, 40])
@pytest.mark.parametrize("case", CASES)
def test_neighbours_match_brute_force(spark, monkeypatch, case, block):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    if block == 40 and case not in ("hot value", "skewed"):
        pytest.skip("blocks matter where cells are hot")
    rng = np.random.default_rng(5)
    x = CASES[case](rng)
    q = np.concatenate([x[::15], CASES[case](rng)[::15]])
    got = {}
    for r in knn.knn_neighbours(_frame(spark, x, "rid", np.arange(len(x))), _frame(spark, q, "qid"), x.shape[1], 5).collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["rid"]))
    for i, want in enumerate(_brute(x, q, 5)):
        found = sorted(got[i])
        assert np.allclose([d for d, _ in found], [d for _, d in want], atol=1e-12)
        assert [j for _, j in found] == [j for j, _ in want]


def _cells(x, wanted):
    pivots = knn.Pivots(x[:wanted])
    cell, r, r_top = pivots.assign(x)
    g = pd.DataFrame({"cell": cell, "n": 1, "r": r, "t": r_top}).groupby("cell")
    stats = pd.DataFrame({"n": g.n.sum(), "low": g.r.min(), "high": g.r.max(), "top_low": g.t.min(), "top_high": g.t.max()}).reset_index()
    return knn.Cells(pivots, stats), cell, r


def test_few_cells_are_searched_again():
    """A query's second search goes to the cells beyond whose bisecting plane it can
    have a neighbour, not to all whose ball it lies in."""
    rng = np.random.default_rng(2)
    x, q = rng.random((30_000, 2)), rng.random((400, 2))
    x[:40] = np.repeat(x[:20], 2, 0)
    cells, cell, _ = _cells(np.unique(x, axis=0)[rng.permutation(29_980)], 300)
    rows = np.unique(x, axis=0)
    cell = cells.pivots.assign(rows)[0]
    d = np.sqrt(((q[:, None, :] - rows[None, :, :]) ** 2).sum(2))
    ub = np.sort(d, 1)[:, 4]
    i, c, _ = cells.within(q, ub)
    found = set(zip(i.tolist(), c.tolist(), strict=True))
    assert {(a, int(cell[b])) for a, b in zip(*np.nonzero(d <= ub[:, None]), strict=True)} <= found
    assert len(found) < 2.5 * len(q)


def test_all_inputs_prune():
    """Share of the rows that a query's cells and distance rings leave; none of the
    true neighbours is left out."""
    rng = np.random.default_rng(1)
    share = {}
    for dims in (2, 5, 8):
        x = rng.standard_normal((4000, dims))
        cells, cell, r = _cells(x, 63)
        q = rng.standard_normal((100, dims))
        d = knn._distances(q, x)
        true = np.sort(d, 1)[:, 4]
        i, c, dq = cells.within(q, true)
        ring = 0
        met = np.zeros(d.shape, bool)
        for a, b, e in zip(i, c, dq, strict=True):
            rows = (cell == b) & (abs(e - r) <= true[a] * (1 + 1e-9) + 1e-9)
            met[a] |= rows
            ring += rows.sum()
        assert met[d <= true[:, None]].all()
        share[dims] = ring / len(q) / len(x)
    assert share[2] < 0.04 and share[5] < 0.35 and share[8] < 0.8


def test_candidates_of_a_query_stay_few_at_any_number_of_rows():
    """Rows compared and pivots met per query, 10^4 to 10^6 rows."""
    rng = np.random.default_rng(3)
    compared = {}
    for n in (10**4, 10**5, 10**6):
        x = rng.standard_normal((n, 2))
        cells, cell, r = _cells(x, max(math.isqrt(n), n // 1000))
        q = rng.standard_normal((40, 2))
        ub = np.sort(knn._distances(q, x), 1)[:, 4]
        i, c, d = cells.within(q, ub)
        assert np.bincount(cell).max() < 40 * n / len(cells.n)
        sizes = pd.Series(r).groupby(cell).apply(np.sort)
        compared[n] = sum(np.searchsorted(sizes[b], e + ub[a], "right") - np.searchsorted(sizes[b], e - ub[a], "left")
                          for a, b, e in zip(i, c, d, strict=True)) / len(q)
        assert len(cells.pivots.tops) ** 2 <= len(cells.n)
    assert max(compared.values()) < 400, compared


def test_few_rows_and_missing_inputs(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0]])
    q = np.array([[0.0, 0.0], [np.nan, 1.0]])
    rows = knn.knn_neighbours(_frame(spark, x, "rid", [1, 2]), _frame(spark, q, "qid"), 2, 5).collect()
    assert sorted((r["qid"], r["rid"]) for r in rows) == [(0, 0), (0, 1)]
