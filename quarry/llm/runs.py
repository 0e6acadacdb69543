"""Operator 13: periodic runs of a text's words, found on its Re-Pair grammar.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` periods
and ``MIN_LENGTH`` words long, that no neighbouring word extends keeping period q.

Re-Pair replaces repeated pairs of word ids by nonterminals, the most frequent
first: in every round a document replaces the pairs counted more than half as
often as its most frequent one; where two overlap, the more frequent wins, and a
rule needs two replaced places. What is left (no pair occurs twice) is paired
evenly up to one root. A run crosses the boundary of exactly one node per place it
occurs in, the smallest that holds it, so the runs across a nonterminal's boundary
are computed once, on its first place in the text, and translated to all its
derivation positions; stretches of one period that overlap by a period merge,
which leaves the maximal ones. Documents of a batch go through all rounds
together, as arrays.

Across a boundary b a run of period q has words q apart equal throughout one of
[b - 2q, b - q], [b - q, b] or [b, b + q]: three spread places of each are compared
for all q at once, what is left is extended word by word. A multiple of a known
period whose stretch holds the place is that stretch again and is skipped.

Time is O(n log n) compared words and a sort per round; memory is bounded by the
words of one block (``BLOCK``) or of one document.

Defined cases: a null or empty text has no words and no runs (hashes of the empty
text); a very long text is a block of its own; repeated rows are judged row by row;
a null doc_id has no hash, so its text is never altered; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.base import bounded_batches, map_by_id, words_of

EXPONENT = 4
MIN_LENGTH = 6
BLOCK = 150_000         # words whose grammars are built together
PROBES = 1 << 20        # (node, period) places probed at once


# ---- grammar ---------------------------------------------------------------

class Nodes:
    """Grammar nodes by their first place (start, middle, end) and all places."""

    def __init__(self) -> None:
        self.first: list[np.ndarray] = []
        self.rule: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.n = 0

    def add(self, start, middle, end, rule, at) -> None:
        self.first.append(np.stack([start, middle, end]))
        self.rule.append(rule + self.n)
        self.at.append(at)
        self.n += len(start)

    def done(self):
        if not self.n:
            z = np.zeros(0, np.int64)
            return np.zeros((3, 0), np.int64), z, z
        return np.concatenate(self.first, 1), np.concatenate(self.rule), np.concatenate(self.at)


def _shuffled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def re_pair(symbols: np.ndarray, doc: np.ndarray, n_docs: int, nodes: Nodes) -> np.ndarray:
    """Add the rules of all documents to ``nodes``; returns which words start a
    symbol of what is left. Equal symbols must belong to one document."""
    opens = np.ones(len(symbols), bool)
    sym, start = symbols.astype(np.int64), np.arange(len(symbols))
    end = start + 1
    join = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    fresh = int(sym.max()) + 1 if len(sym) else 0
    while join.any():
        i = np.flatnonzero(join)
        key = sym[i] * fresh + sym[i + 1]
        # of a stretch of one pair (a a a a) only every second place counts
        again = np.append(False, (key[1:] == key[:-1]) & (i[1:] == i[:-1] + 1))
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(i))))
        counts = (np.arange(len(i)) - head) % 2 == 0
        pairs, of, n = np.unique(key, return_inverse=True, return_counts=True)
        n = np.bincount(of[counts], minlength=len(pairs))
        owner = np.zeros(len(pairs), np.int64)
        owner[of] = doc[start[i]]
        most = np.zeros(n_docs, np.int64)
        np.maximum.at(most, owner, n)
        # pairs that occur once end here, and symbols without a pair leave
        join[i[n[of] < 2]] = False
        go = counts & (n[of] >= 2) & (2 * n[of] > most[owner[of]])
        if not go.any():
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((_shuffled(pairs), n))] = np.arange(1, len(pairs) + 1)
        claim = np.zeros(len(sym) + 1, np.int64)
        claim[i[go]] = rank[of[go]]
        at = i[go]
        wins = (claim[at] > claim[at + 1]) & (claim[at] > claim[at - 1])   # at = 0 reads the unused last place
        at, which = at[wins], of[go][wins]
        enough = np.bincount(which, minlength=len(pairs))[which] >= 2
        at, which = at[enough], which[enough]
        _, first, rule = np.unique(which, return_index=True, return_inverse=True)
        nodes.add(start[at[first]], start[at[first] + 1], end[at[first] + 1], rule, start[at])
        opens[start[at + 1]] = False
        sym[at] = fresh + rule
        fresh += len(first)
        end[at], join[at] = end[at + 1], join[at + 1]
        stay = join | np.append(False, join[:-1])
        stay[at + 1] = False
        # a symbol's pair is with the next one that stays
        sym, start, end, join = sym[stay], start[stay], end[stay], join[stay]
    return opens


def even_tree(opens: np.ndarray, doc: np.ndarray, nodes: Nodes) -> None:
    """Pair neighbouring symbols of each document until one is left."""
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(opens))
    while len(start):
        d = doc[start]
        new = np.append(True, d[1:] != d[:-1])
        place = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        left = np.flatnonzero((place % 2 == 0) & np.append(~new[1:], False))
        if not len(left):
            return
        nodes.add(start[left], start[left + 1], end[left + 1], np.arange(len(left)), start[left])
        end[left] = end[left + 1]
        stay = np.ones(len(start), bool)
        stay[left + 1] = False
        start, end = start[stay], end[stay]


# ---- runs across one boundary ------------------------------------------------

def _reach(w: np.ndarray, i: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The stretch [l, r) of places j around i, low <= j, j + q < high, with
    w[j] == w[j + q] throughout."""
    size, r = 16, i
    while r < high - q:
        stop = min(r + size, high - q)
        bad = w[r:stop] != w[r + q:stop + q]
        if bad.any():
            r += int(bad.argmax())
            break
        r, size = stop, size * 4
    size, left = 16, i
    while left > low:
        stop = max(left - size, low)
        bad = w[stop:left] != w[stop + q:left + q]
        if bad.any():
            left -= int(bad[::-1].argmax())
            break
        left, size = stop, size * 4
    return left, r


def _probe(w: np.ndarray, s, b, e, q):
    """Places (node, period, anchor) at which a run may cross the boundary."""
    def equal(keep, *places):
        for x in places:
            keep = keep[w[x[keep]] == w[x[keep] + q[keep]]]
        return keep

    half = q // 2
    left = equal(np.flatnonzero(b - 2 * q >= s), b - q, b - 2 * q, b - q - half)
    middle = equal(np.flatnonzero((b - q >= s) & (b + q < e)), b, b - q, b - half)
    right = equal(np.flatnonzero(b + 2 * q < e), b, b + q, b + half)
    right = np.union1d(middle, right)
    return np.concatenate([left, right]), np.concatenate([(b - q)[left], b[right]])


def crossing(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (node, start, end, period) of the runs across each node's boundary,
    inside its first place."""
    s, b, e = first
    most = np.where(e - s >= MIN_LENGTH, (e - s) // EXPONENT, 0)
    nodes = np.flatnonzero(most > 0)
    total = np.cumsum(most[nodes])
    out: list[tuple[int, int, int, int]] = []
    at = 0
    while at < len(nodes):
        before = total[at - 1] if at else 0
        stop = max(int(np.searchsorted(total, before + PROBES, side="right")), at + 1)
        part = nodes[at:stop]
        at = stop
        node = np.repeat(part, most[part])
        q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(most[part]) - most[part], most[part])
        keep, anchor = _probe(w, s[node], b[node], e[node], q)
        order = np.lexsort((anchor, q[keep], node[keep]))
        keep, anchor = keep[order], anchor[order]
        node, q = node[keep], q[keep]
        bounds = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(node) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            x = int(node[lo])
            out += _node_runs(w, x, int(s[x]), int(b[x]), int(e[x]), q[lo:hi], anchor[lo:hi])
    return np.array(out, np.int64).reshape(-1, 4)


def _node_runs(w, x, s, b, e, q, anchor) -> list[tuple[int, int, int, int]]:
    out = []
    while len(q):
        p, i = int(q[0]), int(anchor[0])
        l, r = _reach(w, i, p, s, e)
        q, anchor = q[1:], anchor[1:]
        if r - l < p:
            continue
        r += p                              # the words [l, r) have period p
        if l < b < r and r - l >= max(MIN_LENGTH, EXPONENT * p):
            out.append((x, l, r, p))
        # a multiple's stretch around a place inside [l, r) is [l, r) again
        same = (q % p == 0) & (q <= r - l) & (anchor >= l) & (anchor + q < r)
        q, anchor = q[~same], anchor[~same]
    return out


def find_runs(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of each document's runs, by start and period.
    ``ids`` are word ids from 0, equal where words are."""
    n = np.array([len(x) for x in ids], np.int64)
    if not n.sum():
        return [np.zeros((0, 3), np.int64) for _ in ids]
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(ids)), n)
    w = np.concatenate(ids).astype(np.int64) * len(ids) + doc
    nodes = Nodes()
    even_tree(re_pair(w, doc, len(ids), nodes), doc, nodes)
    first, rule, at = nodes.done()
    found = crossing(w, first)
    if not len(found):
        return [np.zeros((0, 3), np.int64) for _ in ids]
    # all derivation positions of the nodes that have runs
    has = np.unique(found[:, 0])
    here = np.isin(rule, has)
    rule, at = rule[here], at[here]
    order = np.argsort(rule, kind="stable")
    rule, at = rule[order], at[order]
    lo, hi = np.searchsorted(rule, found[:, 0]), np.searchsorted(rule, found[:, 0], side="right")
    run = np.repeat(np.arange(len(found)), hi - lo)
    place = at[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]]
    start = place + found[run, 1] - first[0][found[run, 0]]
    end, period = start + found[run, 2] - found[run, 1], found[run, 3]
    # stretches of one period that overlap by a period are one
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(True, period[1:] != period[:-1])) - 1
    far = np.maximum.accumulate(group * (len(w) + 1) + end) - group * (len(w) + 1)
    new = np.append(True, (group[1:] != group[:-1]) | (start[1:] > far[:-1] - period[1:]))
    heads = np.flatnonzero(new)
    start, end, period = start[heads], far[np.append(heads[1:], len(far)) - 1], period[heads]
    order = np.lexsort((period, start))
    rows = np.stack([start, end - start, period], 1)[order]
    cut = np.searchsorted(rows[:, 0], np.append(begin, len(w)))
    return [rows[cut[k]:cut[k + 1]] - [begin[k], 0, 0] for k in range(len(ids))]


# ---- texts -------------------------------------------------------------------

def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, from some place on made periodic in one document of ten (chosen
    by the checksum of its doc_id)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[:n - a]


def report(texts: list[list[bytes]]) -> list[tuple]:
    """n_runs, the strongest run's start, length, period and exponent_milli, the
    runs' and the collapsed text's hashes of each document's words."""
    ids = []
    for words in texts:
        known: dict[bytes, int] = {}
        ids.append(np.array([known.setdefault(x, len(known)) for x in words], np.int64))
    out = []
    for words, rows in zip(texts, find_runs(ids), strict=True):
        best: tuple = (None, None, None, None)
        lines, kept = b"", words
        if len(rows):
            listed = rows.tolist()
            s, l, q = listed[0]
            for s2, l2, q2 in listed[1:]:       # by start, then period: the first of equals stays
                if l2 * q > l * q2:
                    s, l, q = s2, l2, q2
            best = (s, l, q, 1000 * l // q)
            lines = b"".join(b"%d,%d,%d\n" % tuple(r) for r in listed)
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
            np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        out.append((len(rows), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


COLUMNS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
           "runs_sha256": "string", "collapsed_sha256": "string"}


def periodic_runs(docs: DataFrame, change=planted) -> DataFrame:
    """One row per document: doc_id and ``COLUMNS``; ``change(words, doc_id)`` may
    alter the words first (``None``: the texts as they are)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size, keys = [], 0, []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                if change is not None:
                    words = change(words, None if key is None else int(key))
                held.append(words)
                keys.append(key)
                size += len(words)
                if size >= BLOCK:
                    yield rows(keys, report(held))
                    held, size, keys = [], 0, []
            if held:
                yield rows(keys, report(held))

    def rows(keys, found) -> pd.DataFrame:
        out = pd.DataFrame({"doc_id": np.array(keys, object)})
        for c, values in zip(COLUMNS, zip(*found, strict=True), strict=True):
            out[c] = pd.array(values, "Int64") if COLUMNS[c] == "long" else np.array(values, object)
        return out

    return map_by_id(docs.select("doc_id", "text"), run, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
