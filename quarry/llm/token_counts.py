"""Operator 6: token counts by section through offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' byte lengths, summed up and
mapped to characters, give every token's character span; the spans are joined to
the document's sections (disjoint, ordered character intervals) by binary search
over the section starts. A token that crosses a boundary is allocated by a rule:

* ``start``: the section of its first character (counts are whole numbers and add
  up to the document's tokens wherever sections cover it);
* ``majority``: the section with most of its characters, the earlier of equals;
* ``split``: every section gets the share of the token's characters it holds.

A character that several tokens share (one token ends inside it) belongs to each
of them.

Sections are a text's lines with their line feeds (``lines_of``), or the fields
of a row joined by line feeds (``count_fields``).

Defined cases: a null or empty text is one empty section without tokens; tokens
outside every section are counted nowhere; repeated rows are counted row by row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, map_by_id
from quarry.llm.bpe import FastIds, shared_vocabulary

RULES = ("start", "majority", "split")


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [from, to) of tokens with these byte lengths."""
    b = np.frombuffer(raw, np.uint8)
    character = np.cumsum((b & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return character[ends - lengths], character[ends - 1] + 1


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of a text, each with its line feed."""
    if not text:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    if len(ends) > 1 and ends[-1] == ends[-2]:      # the text ends with a line feed
        ends = ends[:-1]
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per section (lo, hi): its tokens by ``rule``, and how many tokens that begin
    in it end outside."""
    n = len(lo)
    first = np.searchsorted(lo, start, "right") - 1
    inside = (first >= 0) & (start < hi[np.maximum(first, 0)])
    crossing = np.bincount(first[inside & (end > hi[np.maximum(first, 0)])], minlength=n)
    if rule == "start":
        return np.bincount(first[inside], minlength=n).astype(float), crossing
    # every (token, section) overlap: a token meets the sections first .. last
    last = np.searchsorted(lo, end, "left") - 1
    first = np.maximum(np.searchsorted(hi, start, "right"), 0)
    meets = np.maximum(last - first + 1, 0)
    token = np.repeat(np.arange(len(start)), meets)
    section = np.arange(len(token)) - np.repeat(np.cumsum(meets) - meets, meets) + first[token]
    shared = np.minimum(end[token], hi[section]) - np.maximum(start[token], lo[section])
    if rule == "split":
        return np.bincount(section, shared / (end - start)[token], minlength=n), crossing
    order = np.lexsort((section, -shared, token))
    _, best = np.unique(token[order], return_index=True)
    best = order[best]
    return np.bincount(section[best][shared[best] > 0], minlength=n).astype(float), crossing


def _counted(rows: DataFrame, key: str, path: str, pattern: str, rule: str, sections) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(rows.sparkSession)
    shared = shared_vocabulary(rows.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = FastIds(*shared.value, pattern)
        size = np.array([len(t) for t in shared.value[0]], np.int64)
        for b in batches:
            parts = []
            for k, row in zip(b["key"], b["parts"], strict=True):
                text, lo, hi = sections(row)
                start, end = token_spans(text.encode("utf-8", "surrogatepass"), size[ids_of(text)]) if text else (np.zeros(0, np.int64),) * 2
                n, crossing = attribute(start, end, lo, hi, rule)
                parts.append((np.repeat(k, len(lo)), np.arange(len(lo)), lo, hi - lo, n, crossing))
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pd.DataFrame(dict(zip(["key", "section", "start", "n_chars", "n_tokens", "n_crossing"], cols, strict=True)))

    out = map_by_id(rows, run, "section int, start long, n_chars long, n_tokens double, n_crossing long", "key")
    kind = "double" if rule == "split" else "long"
    return out.withColumn("n_tokens", F.col("n_tokens").cast(kind)).withColumnRenamed("key", key)


def count_lines(docs: DataFrame, path: str, pattern: str, rule: str = "start", key: str = "doc_id") -> DataFrame:
    """One row per line of every text: key, section (from 0), start, n_chars,
    n_tokens and n_crossing (tokens that begin here and end later)."""
    def sections(text):
        text = text or ""
        return text, *lines_of(text)

    return _counted(docs.select(F.col(key).alias("key"), F.col("text").alias("parts")), key, path, pattern, rule, sections)


def count_fields(rows: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "start", key: str = "doc_id") -> DataFrame:
    """The same for string columns: a row's ``fields`` joined by line feeds are one
    document, a field (with the line feed after it) is a section."""
    def sections(values):
        values = ["" if v is None else v for v in values]
        ends = np.cumsum([len(v) + 1 for v in values])
        ends[-1] -= 1
        return "\n".join(values), np.concatenate([[0], ends[:-1]]), ends

    return _counted(rows.select(F.col(key).alias("key"), F.array(*fields).alias("parts")), key, path, pattern, rule, sections)
