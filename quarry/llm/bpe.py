"""Operator 9: byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut by the split pattern; each match (pre-token) is encoded alone.
Tier one is a minimal perfect hash over the vocabulary: a bucket's displacement
sends every vocabulary entry to its own slot, one comparison of bytes proves a
hit, and the whole pre-token is one id. Tier two merges a miss: bytes form a
linked list, a heap yields the adjacent pair of lowest rank (leftmost first),
and stale heap entries are recognised by the spans they name.

The vocabulary file is read once on the driver and broadcast (its size is fixed
by the vocabulary). Tasks keep recent pre-tokens in two generations of at most
``CACHE`` entries.

Defined cases: null and empty texts have no ids; special-token strings are
ordinary text; any bytes round-trip; columns other than doc_id and text are
ignored; repeated rows are encoded row by row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.base import bounded_batches, map_by_id

CACHE = 200_000             # pre-tokens kept in each of two generations
KEYS_PER_BUCKET = 4
_M64 = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in rank order from a ``base64 rank`` file."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without a gap")
    return [t for _, t in pairs]


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` file and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must match as they are")
    return {t["content"]: t["id"] for t in added}


def _place(h: int, seed: int, n: int) -> int:
    """Slot of a key's hash under a bucket's displacement."""
    x = ((h ^ seed) * 0x9E3779B97F4A7C15) & _M64
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """Minimal perfect hash: n keys, n slots. Larger buckets search a displacement
    first; a bucket of one key stores its slot itself (as ~slot)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // KEYS_PER_BUCKET)
        grouped: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            grouped[(h >> 32) % self.buckets].append(i)
        self.seeds, self.slots = [0] * self.buckets, [-1] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            members = grouped[b]
            if len(members) < 2:
                break
            seed = 0
            while True:
                at = [_place(hashes[i], seed, n) for i in members]
                if all(self.slots[s] < 0 for s in at) and len(set(at)) == len(at):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(members, at, strict=True):
                self.slots[s] = i
        free = iter([s for s in range(n) if self.slots[s] < 0])
        for b, members in enumerate(grouped):
            if len(members) == 1:
                s = next(free)
                self.seeds[b], self.slots[s] = ~s, members[0]

    def candidate(self, key: bytes) -> int:
        """The one index whose key may equal ``key``."""
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[(h >> 32) % self.buckets]
        return self.slots[~seed if seed < 0 else _place(h, seed, self.n)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging the adjacent pair of lowest rank again and
    again. ``end[i]`` links the part that starts at i to its successor, ``start``
    links back."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end, start = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if j <= i or j >= n or end[j] != e:     # one of the two parts is no more
            continue
        end[i], end[j] = e, -1
        start[e] = i
        if e < n and (r := ranks.get(piece[i:end[e]])) is not None:
            heapq.heappush(heap, (r, i, end[e]))
        p = start[i]
        if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: list[bytes], perfect: PerfectHash, pattern: str):
        super().__init__()
        self.vocabulary, self.perfect = vocabulary, perfect
        self.ranks = {t: i for i, t in enumerate(vocabulary)}
        self.find = regex.compile(pattern).findall
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            i = self.perfect.candidate(raw)
            if self.vocabulary[i] == raw:
                ids = i.to_bytes(4, "little")
            else:
                ids = np.array(merge(raw, self.ranks), "<u4").tobytes()
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, 4 bytes each."""
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class FastIds:
    """Ids of a text by the rank library, or by the heap for texts so long that its
    split could exhaust the stack; both give the same ids (tests compare them).
    ``added`` tokens get their own ids wherever they stand, the leftmost and then the
    longest first, and the text between them is encoded part by part; without them
    their strings are ordinary text."""

    LONG_TEXT = 200_000     # characters

    def __init__(self, vocabulary: list[bytes], perfect: PerfectHash, pattern: str, added: dict[str, int] | None = None):
        import tiktoken
        self.added = added or {}
        found = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.split = re.compile(f"({found})").split if found else None
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
        self.heap = Encoder(vocabulary, perfect, pattern)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.split and len(parts := self.split(text)) > 1:   # every second part is an added token
            return np.concatenate([np.array([self.added[t]], "<u4") if k % 2 else self.ordinary(t) for k, t in enumerate(parts)])
        return self.ordinary(text)

    def ordinary(self, text: str) -> np.ndarray:
        if len(text) >= self.LONG_TEXT:
            return np.frombuffer(self.heap.encode(text), "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def shared_vocabulary(spark, path: str):
    """Broadcast (vocabulary, perfect hash)."""
    vocabulary = read_ranks(path)
    return spark.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary)))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every document."""
    return _run(docs, path, pattern, "ids binary",
                lambda enc, text: (enc.encode(text),), ["ids"])


def _digests(enc: Encoder, text: str | None) -> tuple:
    ids = enc.encode(text)
    return (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest())


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of their decoded bytes."""
    return _run(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                _digests, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, path: str, pattern: str, schema: str, of, columns: list[str]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(*shared.value, pattern)
        for b in batches:
            out = pd.DataFrame([of(enc, t) for t in b["text"]], columns=columns)
            out.insert(0, "doc_id", b["doc_id"].to_numpy(object))
            yield out

    return map_by_id(docs.select("doc_id", "text"), run, schema)
