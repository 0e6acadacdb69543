"""Operator 5: best-fit packing with vector capacities.

Every document becomes ids and a closing id; one longer than a sequence is cut
into full pieces, of which the first alone may be shorter. Pieces are dealt into
blocks of about ``BLOCK_DOCS`` documents, and each block packs its pieces by
decreasing length. A sequence has three residual capacities: tokens, documents
and attention cost (the sum of squared lengths). Of the sequences that have room
under every one, the piece goes to that with the least weighted norm of what
would be left (``rule="norm"``) or the largest weighted dot product of the piece
and the residual (``rule="dot"``); if none has room, a new one is opened.

With the default capacities the token limit alone binds (1024 documents of one
token or one of 1024 tokens cost less than the others allow), which gives the
fewest sequences; lower ones can be given.

Blocks are a fixed size, so work and memory per task do not grow with the input,
and a block loses less than one sequence to its border.

Ids are those of the byte-level vocabulary's ``tokenizers`` file: texts are cut at
its added tokens, which keep their own ids, and between them the vocabulary's pairs
in rank order give the file's ids (tests compare both). The rank reader is four
times as fast, so tasks use it.

Defined cases: null and empty texts are the closing id alone; repeated rows are
packed each; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, plain
from quarry.llm.bpe import FastIds, read_added, shared_vocabulary

SEQUENCE_TOKENS = 1024
END_ID = 2
BLOCK_DOCS = 20_000
WEIGHTS = (1.0, 0.1, 0.1)   # of tokens, documents and attention cost


def piece_starts(length: int, capacity: int = SEQUENCE_TOKENS) -> list[int]:
    """Where the pieces of a document of ``length`` tokens start."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def best_fit(lengths: np.ndarray, tokens: int = SEQUENCE_TOKENS, docs: int | None = None, cost: int | None = None,
             weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths must come in decreasing order
    and none may exceed ``tokens``."""
    docs, cost = docs or tokens, cost or tokens * tokens
    n = len(lengths)
    if n and int(lengths[0]) ** 2 > cost:
        raise ValueError("a piece alone exceeds the attention cost of a sequence")
    scale = np.array([weights[0] / tokens, weights[1] / docs, weights[2] / cost])
    left = np.zeros((3, n))             # residuals of the open sequences
    name = np.zeros(n, np.int64)        # their numbers
    used = np.zeros(n, np.int64)        # tokens of every sequence so far
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_open = made = 0
    least = int(lengths[-1]) if n else 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1, length * length], float)[:, None]
        rest = left[:, :n_open] - need
        fits = np.flatnonzero((rest >= 0).all(0))
        if len(fits):
            if rule == "norm":
                k = fits[((rest[:, fits] * scale[:, None]) ** 2).sum(0).argmin()]
            else:
                k = fits[(left[:, fits] * need * scale[:, None] ** 2).sum(0).argmax()]
        else:
            k = n_open
            left[:, k], name[k] = (tokens, docs, cost), made
            n_open += 1
            made += 1
        s = sequence[i] = name[k]
        offset[i] = used[s]
        used[s] += length
        left[:, k] -= need[:, 0]
        if left[0, k] < least or left[1, k] < 1 or left[2, k] < least * least:      # nothing more fits: close it
            n_open -= 1
            left[:, k], name[k] = left[:, n_open], name[n_open]
    return sequence, offset


def pack_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, end_id: int = END_ID,
                   tokens: int = SEQUENCE_TOKENS, max_docs: int | None = None, max_cost: int | None = None,
                   rule: str = "norm", with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset (and ``ids`` if asked for). ``added``: the vocabulary's added tokens; by
    default those of the default vocabulary, and none for another one."""
    import public_tokenizers

    bounded_batches(docs.sparkSession)
    if added is None and path is None:
        added = read_added(public_tokenizers.path("byte_bpe_50k.json"))
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    shared = shared_vocabulary(docs.sparkSession, path)
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = FastIds(*shared.value, pattern, added)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(ids_of(text), np.uint32(end_id))
                for k, at in enumerate(starts := piece_starts(len(ids), tokens)):
                    to = starts[k + 1] if k + 1 < len(starts) else len(ids)
                    part = ids[at:to].astype("<u4").tobytes()
                    rows.append((doc_id, k, at, to - at, zlib.crc32(part), part if with_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield out

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = plain(pdf).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        whole = int((lengths == tokens).sum()) if max_cost is None or max_cost >= tokens * tokens else 0
        # full pieces are sequences of their own
        sequence, offset = best_fit(lengths[whole:], tokens, max_docs, max_cost, rule=rule)
        out = pdf.drop(columns="block")
        out["sequence_id"] = (np.int64(pdf["block"].iloc[0]) << 32) + np.concatenate([np.arange(whole), whole + sequence])
        out["offset"] = np.concatenate([np.zeros(whole, np.int64), offset])
        return out if with_ids else out.drop(columns="ids")

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, schema + ", ids binary")
    # equal doc_ids must not fill one block: the row's place in its task deals them out
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks))
    packed = rows.withColumn("block", block).groupBy("block").applyInPandas(
        pack, schema + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
