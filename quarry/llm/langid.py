"""Operator 10: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams of lower-cased
letters (anything else is one separator). Document frequencies count every
labelled training document, and every language that labels one is learned. The
weights come from a bounded sample (``MAX_TRAIN_ROWS``, dealt out in proportion
with ``MIN_LANG_ROWS`` for a language that has them) with
follow-the-regularised-leader (per-coordinate rates, L1 and L2), and a temperature
fitted on a part of each language's sample that the weights never saw turns scores
into probabilities. Predictions read whole texts.

With relative term frequencies the score of a class is a mean over n-gram
positions of ``idf * weight``, so a batch is scored by one gather and one
segmented sum, in blocks of ``BLOCK`` characters whatever a text's length.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
with nothing to learn from (empty table, no language) every text is ``und``;
one language alone is predicted with score 1; ties go to the first language
in sorted order; repeated rows count as often as they occur; other columns are
ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, map_by_id

MAX_TRAIN_ROWS = 3000       # documents the weights and the temperature are fitted on, beside the floor
MIN_LANG_ROWS = 50          # of them for each language, if it has them (MAX_TRAIN_ROWS / languages, if that is less)
CALIBRATION_SHARE = 5       # every fifth of a language's fits the temperature only
HASH_BITS = 17
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
EPOCHS = 2
TERM_SCALE = 100.0          # relative frequencies are small; one constant for all of them
BLOCK = 1 << 18
CHUNKS = 32                 # document frequencies travel as so many slices
SUM_TASKS = 256            # tasks whose sums are added up together
UNDETERMINED = "und"
MIN_SCORE = 0.3             # least score of a document that ``identified`` keeps (texts in two languages score low)
SURE = 1.2                  # or so many times an even score, if that is less (more than four languages)

_D = 1 << HASH_BITS
_MIX = np.uint32(0x9E3779B1)


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> code of its lower case, 0 for what is no letter."""
    codes = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            codes[c] = ord(s.lower()[0])
    return codes


def letters_of(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams (n = 1, 2, 3) starting at each position, -1 where the first
    character is no letter. ``codes`` carries two more characters than positions."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    h1 = a * _MIX
    h2 = ((h1 ^ b) + np.uint32(0x85EBCA6B)) * _MIX
    h3 = ((h2 ^ c) + np.uint32(0xC2B2AE35)) * _MIX
    out = np.stack([h1, h2, h3]) >> np.uint32(32 - HASH_BITS)
    out = out.astype(np.int32)
    out[:, a == 0] = -1
    return out


def blocks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of one long or many joined texts, block by block."""
    codes = np.concatenate([codes, np.zeros(2, np.uint32)])
    for at in range(0, len(codes) - 2, BLOCK):
        yield grams(codes[at:at + BLOCK + 2])


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, how often each occurs) of a whole text."""
    total = np.zeros(_D, np.int64)
    for g in blocks(letters_of(text)):
        total += np.bincount(g[g >= 0], minlength=_D)
    at = np.flatnonzero(total)
    return at, total[at]


# ---- learning ------------------------------------------------------------

def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, width: int) -> np.ndarray:
    """Weights (``width`` n-grams x classes) of a softmax regression, one pass per
    epoch of follow-the-regularised-leader."""
    z, n, w = (np.zeros((width, classes)) for _ in range(3))
    for _ in range(EPOCHS):
        for (at, x), k in zip(rows, y, strict=True):
            s = x @ w[at]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1
            g = np.outer(x, p)
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w[at]
            n[at] = new
            zi = z[at]
            w[at] = np.where(np.abs(zi) <= L1, 0.0,
                             -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(new)) / ALPHA + L2))
    return w


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss (golden-section search)."""
    if not len(y):
        return 1.0

    def loss(log_t):
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()) + 1e-4 * log_t**2

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi, b = b, a
            a = hi - r * (hi - lo)
        else:
            lo, a = a, b
            b = lo + r * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each hashed n-gram occurs, and how many texts
    there are. A task adds up its own documents; the slices (``CHUNKS``) of at most
    ``SUM_TASKS`` tasks are summed together, then their sums, and the fixed-size
    result comes to the driver."""
    width = _D // CHUNKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(_D, np.int64), 0
        for b in batches:
            for text in b["text"]:
                seen = np.zeros(_D, bool)
                for g in blocks(letters_of(text)):
                    seen[g[g >= 0]] = True
                df += seen
                n += 1
        if n:
            yield pd.DataFrame({"chunk": range(CHUNKS), "n": n,
                                "df": [zlib.compress(df[i * width:(i + 1) * width].tobytes(), 1) for i in range(CHUNKS)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for x in pdf["df"]:
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "n": [pdf["n"].sum()], "df": [zlib.compress(total.tobytes(), 1)]})

    schema = "chunk int, n long, df binary"
    slices = docs.select("text").mapInPandas(count, schema).withColumn("some", F.floor(F.spark_partition_id() / SUM_TASKS))
    found = slices.groupBy("chunk", "some").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    df, n = np.zeros(_D, np.int64), 0
    for r in found:
        df[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["df"])), np.int64)
        n = r["n"]
    return df, n


def quotas(counts: dict[str, int], max_rows: int) -> dict[str, int]:
    """Documents of each language in the sample: all, if they are ``max_rows`` at
    most, else its share of ``max_rows`` and never fewer than the floor or all it has."""
    n = sum(counts.values())
    if n <= max_rows:
        return dict(counts)
    floor = max(1, min(MIN_LANG_ROWS, max_rows // len(counts)))
    return {lang: min(c, max(floor, max_rows * c // n)) for lang, c in counts.items()}


def sampled(docs: DataFrame, max_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows of ``docs`` with their hash ``k``, quotas): of each language the quota's
    smallest hashes of doc_id and text, and more only where whole rows repeat. Hashes
    below a bound that twice the quota should lie under are counted; a language that
    has fewer there is counted again below a larger one. No text moves."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    quota = quotas(counts, max_rows)
    docs = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    lowest, highest = -(1 << 63), (1 << 63) - 1
    cut = {lang: highest for lang, c in counts.items() if quota[lang] == c}
    reach = {lang: 2 * quota[lang] + 64 for lang in counts if lang not in cut}

    def below(bounds: dict[str, int]) -> DataFrame:
        if not bounds:
            return docs.limit(0)
        table = docs.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound long")
        return docs.join(F.broadcast(table), "lang").where("k <= bound").drop("bound")

    while reach:
        bounds = {lang: min(highest, lowest + (1 << 64) * m // counts[lang]) for lang, m in reach.items()}
        found: dict[str, list] = {lang: [] for lang in reach}
        for r in below(bounds).groupBy("lang", "k").count().collect():
            found[r["lang"]].append((r["k"], r["count"]))
        for lang, keys in found.items():
            rows = 0
            for k, c in sorted(keys):
                rows += c
                if rows >= quota[lang]:
                    cut[lang] = k
                    del reach[lang]
                    break
            else:
                reach[lang] *= 4
    return below(cut), quota


def fit(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """Learn from rows (doc_id, text, lang) whose text and lang are given."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    df, n = document_frequencies(docs)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts_of(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"].to_numpy(object), "k": b["k"].to_numpy(), "at": [a.astype(np.int32).tobytes() for a, _ in found],
                                "x": [c.astype(np.int64).tobytes() for _, c in found]})

    some, quota = sampled(docs, max_rows)
    some = some.mapInPandas(counted, "lang string, k long, at binary, x binary")
    # rows that repeat come once with their number; the last of a quota may be among them
    rows = some.groupBy("lang", "k", "at", "x").count().toPandas().sort_values(["lang", "k", "at", "x"], kind="stable")
    before = rows.groupby("lang")["count"].cumsum() - rows["count"]
    rows = rows.loc[rows.index.repeat(np.minimum(rows["lang"].map(quota) - before, rows["count"]).clip(lower=0))]
    rows = rows.sort_values(["lang", "at", "x"], kind="stable").sample(frac=1, random_state=7)
    langs = sorted(rows["lang"].unique())
    x, y = [], []
    for lang, at, c in zip(rows["lang"], rows["at"], rows["x"], strict=True):
        at, c = np.frombuffer(at, np.int32), np.frombuffer(c, np.int64)
        if len(at):
            x.append((at, TERM_SCALE * c / c.sum() * idf[at]))
            y.append(langs.index(lang))
    if not x:
        return None
    y = np.array(y)
    # a language with fewer documents than that share is learned from all of them
    nth = pd.Series(y).groupby(y).cumcount().to_numpy()
    held = nth % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    # only n-grams of the sample have weights
    seen = np.unique(np.concatenate([at for at, _ in x]))
    x = [(np.searchsorted(seen, at), v) for at, v in x]
    w = ftrl([r for r, h in zip(x, held, strict=True) if not h], y[~held], len(langs), len(seen))
    logits = np.array([v @ w[at] for (at, v), h in zip(x, held, strict=True) if h]).reshape(-1, len(langs))
    some = np.abs(w).sum(1) > 0
    return {"langs": langs, "at": seen[some].astype(np.int32), "t": temperature(logits, y[held]),
            "w": (TERM_SCALE * idf[seen[some], None] * w[some]).astype(np.float32)}


# ---- prediction ----------------------------------------------------------

def classify(texts, model: dict | None) -> pd.DataFrame:
    """``lang_pred`` and ``score`` of each whole text."""
    texts = list(texts)
    lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if model is None or not texts:
        return pd.DataFrame({"lang_pred": lang, "score": score})
    k = len(model["langs"])
    w = np.zeros((_D + 1, k), np.float32)       # the last row, reached by -1, stays 0
    w[model["at"]] = model["w"]
    sums, n = np.zeros((len(texts), k)), np.zeros(len(texts))
    gap = np.zeros(2, np.uint32)

    def flush(part: list[tuple[int, np.ndarray]]) -> None:
        joined = np.concatenate([x for _, c in part for x in (c, gap)])
        starts = np.cumsum([0, *(len(c) + 2 for _, c in part[:-1])])
        rows = [i for i, _ in part]
        g = grams(np.concatenate([joined, gap]))
        per = w[g[0]]
        per += w[g[1]]
        per += w[g[2]]
        sums[rows] += np.add.reduceat(per, starts, axis=0, dtype=np.float64)
        n[rows] += 3 * np.add.reduceat(g[0] >= 0, starts, dtype=np.int64)

    part, size = [], 0
    for i, text in enumerate(texts):
        codes = letters_of(text)
        for at in range(0, len(codes), BLOCK):
            # a block sees the two characters after it, so no n-gram is lost at its end
            if at + BLOCK >= len(codes):
                part.append((i, codes[at:]))
                size += len(part[-1][1])
            else:
                g = grams(codes[at:at + BLOCK + 2] if at + BLOCK + 2 <= len(codes) else np.append(codes[at:], gap)[:BLOCK + 2])
                sums[i] += (w[g[0]] + w[g[1]] + w[g[2]]).sum(0, dtype=np.float64)
                n[i] += 3 * (g[0] >= 0).sum()
        if size >= BLOCK:
            flush(part)
            part, size = [], 0
    if part:
        flush(part)
    has = n > 0
    if has.any():
        s = sums[has] / n[has, None] / model["t"]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        lang[has] = np.array(model["langs"], object)[p.argmax(1)]
        score[has] = p.max(1)
    return pd.DataFrame({"lang_pred": lang, "score": score})


def held_out(doc_id="doc_id"):
    """Column: this document is kept out of all learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = classify(b["text"], model)
            out.insert(0, "held_out", b["held_out"].to_numpy())
            out.insert(0, "doc_id", b["doc_id"].to_numpy(object))
            yield out

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_by_id(rows, run, "held_out boolean, lang_pred string, score double")


def least_score(model: dict | None) -> float:
    """The bound of ``identified``: with more languages an even score is lower."""
    return min(MIN_SCORE, SURE / len(model["langs"])) if model else MIN_SCORE


def identified(docs: DataFrame, model: dict | None, min_score: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language is recognised
    with ``min_score`` (by default ``least_score``) at least; no row is shuffled."""
    bounded_batches(docs.sparkSession)
    min_score = least_score(model) if min_score is None else min_score

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = classify(text, model)
        return (out["lang_pred"] != UNDETERMINED) & (out["score"] >= min_score)

    return docs.where(known(F.col("text")))
