"""Operator 7: WARC archives with a verified boundary chain.

Writing: one record per page. Of the pages with equal payloads of ``MIN_REVISIT``
bytes or more, the smallest page_id becomes a response and the others revisit
it. Spark's text writer joins the records; each ends with its line separator, an
empty line.

Reading: the archives are split anywhere. The text reader cuts a split at every
occurrence of the magic, also at those inside payloads; a task lists its
candidates with header, successor offset (from Content-Length) and, where the
whole payload is at hand, its digest. Inside a split a candidate's successors
are followed by pointer doubling to the offset at which they leave it; sums of
the splits' sizes turn these into offsets of the file, and pointer jumping over
the few entry offsets, from the start of each file, finds the entry that each
split is really entered at. Only candidates on the chain from there are records.
Payloads that a magic cuts into several pieces are put together again and hashed:
the pieces are read a second time and found by their digests, so that this read may
have other splits than the first.

Defined cases: a null page is an empty payload; smaller payloads are responses
all; rows that repeat the smallest page_id of their group are responses each; a
null page_id is written as ``null`` and read as null; control characters in a
URL are percent-encoded; an empty table gives no record; other columns are
ignored. A record whose chain breaks (a wrong Content-Length) ends its file.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, mark, plain, saved
from quarry.session import checkpoint_dir

MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"   # the pages carry no date
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID = "urn:page:"

# ids travel as text: beside a null, pandas would make them inexact floats
HEADER_TYPES = "record_type string, page_id string, refers_to string, digest string"
CANDIDATE = ("file string, block long, ordinal int, at long, size long, length long, following int, leaves long, complete boolean, "
             + HEADER_TYPES + ", payload_bytes long, payload_digest string, content string")
COLUMNS = [c.split()[0] for c in CANDIDATE.split(", ")]


# ---- writing -------------------------------------------------------------

def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id and the record (without its closing empty line) of every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # only payloads that occur twice or more meet their pages again; no other page is shuffled
    twins = saved(p.where(F.col("n") >= min_revisit).groupBy("digest")
                  .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    p = mark(p, "digest", twins, "digest")
    p = p.where("marked").join(twins, "digest", "left").unionByName(p.where("not marked").withColumn("first", F.lit(None).cast("long")))
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    urn = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.coalesce("url", F.lit(""))
    for c in range(32):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("first"), F.lit("\r\n"))).otherwise("")
    return p.select("page_id", F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"), more,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(RECORD_END), http, body).alias("record"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    records(pages, min_revisit).select("record").write.option("lineSep", RECORD_END).text(path)


# ---- reading -------------------------------------------------------------

def parse_header(piece: bytes) -> dict | None:
    """Fields of the record whose magic came right before ``piece``; None if it
    is no record header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(re.findall(rb"(?m)^([A-Za-z-]+): ?([^\r\n]*)\r?$", piece[:end]))
    length = fields.get(b"Content-Length", b"")
    if not length.isdigit() or len(length) > 18 or b"WARC-Type" not in fields:
        return None

    def urn(name):
        m = re.fullmatch(rb"<" + ID.encode() + rb"(-?\d{1,19})>", fields.get(name, b""))
        return m[1].decode() if m else None

    return {"content": end + 4, "length": int(length), "record_type": fields[b"WARC-Type"].decode("latin-1"),
            "page_id": urn(b"WARC-Record-ID"), "refers_to": urn(b"WARC-Refers-To"),
            "digest": fields.get(b"WARC-Payload-Digest", b"").decode("latin-1").removeprefix("sha256:")}


def payload_of(block: bytes, record_type: str, digest: str) -> tuple[int | None, str]:
    """(bytes, digest) of the payload behind the HTTP header of a record's block;
    a revisit names both instead of carrying it."""
    cut = block.find(b"\r\n\r\n")
    if record_type == "revisit":
        m = re.search(rb"(?mi)^Content-Length: ?(\d{1,18})\r?$", block[:max(cut, 0)])
        return (int(m[1]) if m else None), digest
    payload = block[cut + 4:] if cut >= 0 else block
    return len(payload), hashlib.sha256(payload).hexdigest()


def _leaving(following: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Offset at which the chain from each candidate leaves the split (-1: it
    breaks). ``following``: next candidate or -1; ``out``: offset where that one
    leaves by itself or -1. Pointer doubling: the jumps' length doubles."""
    n = len(following)
    if not n:
        return out
    jump = np.where(following >= 0, following, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return out[jump]
        jump = further


def candidates(archive: DataFrame) -> DataFrame:
    """Every candidate of every split, with offsets relative to the split's first
    piece, and one closing row (ordinal -1) with the split's size."""
    sep = len(MAGIC)

    def flush(file, block, rows, total):
        at = {r["at"]: i for i, r in enumerate(rows)}
        following, out = np.full(len(rows), -1), np.full(len(rows), -1)
        for i, r in enumerate(rows):
            if r["length"] is None:
                continue
            to = r["at"] + r["length"]
            if to >= total - sep:       # the next split's first magic lies at total - sep
                out[i] = to
            else:
                following[i] = at.get(to, -1)
        leaves = _leaving(following, out)
        for i, r in enumerate(rows):
            r |= {"file": file, "block": block, "following": int(following[i]), "leaves": int(leaves[i])}
        return pd.DataFrame([*rows, {"file": file, "block": block, "ordinal": -1, "size": total}], columns=COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, total, ordinal = None, [], 0, 0
        for b in batches:
            for file, block, piece, digest in zip(b["file"], b["block"], b["piece"], b["content"], strict=True):
                if (file, block) != now:
                    if now is not None:
                        yield flush(*now, rows, total)
                    now, rows, total, ordinal = (file, block), [], 0, 0
                row = {"ordinal": ordinal, "at": total - sep, "size": len(piece) + sep, "complete": False, "content": digest}
                if block == 0 and ordinal == 0:
                    row["at"] = -sep - 1        # what comes before the first magic of a file
                elif head := parse_header(piece):
                    row |= {k: head[k] for k in ("record_type", "page_id", "refers_to", "digest")}
                    row["length"] = sep + head["content"] + head["length"] + len(RECORD_END)
                    if head["content"] + head["length"] <= len(piece):
                        content = piece[head["content"]:head["content"] + head["length"]]
                        row["complete"] = True
                        row["payload_bytes"], row["payload_digest"] = payload_of(content, head["record_type"], head["digest"])
                row.setdefault("length", None)
                rows.append(row)
                total += len(piece) + sep
                ordinal += 1
        if now is not None:
            yield flush(*now, rows, total)

    def typed(batches):
        for out in run(batches):
            for c in ("at", "size", "length", "payload_bytes", "following", "leaves", "ordinal", "block"):
                out[c] = out[c].astype("Int64")
            for c in ("record_type", "page_id", "refers_to", "digest", "payload_digest", "content"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    return archive.mapInPandas(typed, CANDIDATE)


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece, content): the pieces between magics and their digests,
    split by split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"), F.sha2(F.col("value").cast("binary"), 256).alias("content"))


def _entries(found: DataFrame, bases: DataFrame) -> DataFrame:
    """(file, off): offsets at which the chain from each file's start enters a
    split, by pointer jumping over the offsets at which candidates leave one."""
    jumps = (found.where("leaves >= 0").join(bases, ["file", "block"])
             .select("file", (F.col("base") + F.col("at")).alias("off"), (F.col("base") + F.col("leaves")).alias("to")))
    targets = jumps.select("file", F.col("to").alias("off")).union(bases.select("file", F.lit(0).cast("long").alias("off"))).distinct()
    jumps = saved(jumps.join(targets, ["file", "off"], "left_semi"))
    reached = saved(bases.select("file", F.lit(0).cast("long").alias("off")).distinct())
    n = reached.count()
    while True:
        step = reached.join(jumps, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = saved(reached.union(step).distinct())
        more = reached.count()
        if more == n:
            return reached
        n = more
        j = jumps.select("file", F.col("off").alias("to"), F.col("to").alias("then"))
        jumps = saved(jumps.join(j, ["file", "to"], "left").select("file", "off", F.coalesce("then", "to").alias("to")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and intact
    (the payload has the digest its header names) of every record."""
    bounded_batches(spark)
    found = saved(candidates(open_archives(spark, path)))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(found.where("ordinal = -1").select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), "size"))
    pieces = found.where("ordinal >= 0")
    sep = len(MAGIC)
    entries = _entries(pieces, bases)
    entered = entries.join(bases.withColumnRenamed("size", "total"), "file").where(
        (F.col("off") >= F.col("base") - sep) & (F.col("off") < F.col("base") + F.col("total") - sep)
    ).select("file", "block", (F.col("off") - F.col("base")).alias("entry"), "base")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = plain(pdf).sort_values("ordinal")
        at = pdf["at"].to_numpy()
        following = pdf["following"].to_numpy()
        hit = np.flatnonzero((at == pdf["entry"].to_numpy()) & (at >= -sep))
        on = np.zeros(len(pdf), bool)
        i = int(hit[0]) if len(hit) else -1
        while i >= 0:
            on[i] = True
            i = int(following[i])
        return pdf.assign(on=on & pdf["length"].notna().to_numpy())

    schema = CANDIDATE + ", entry long, base long, on boolean"
    chain = saved(pieces.join(entered, ["file", "block"]).groupBy("file", "block").applyInPandas(walk, schema).where("on")
                  .select("file", (F.col("base") + F.col("at")).alias("off"), "length", "complete", "record_type", "page_id", "refers_to",
                          "digest", "payload_bytes", "payload_digest"))
    out = chain.where("complete").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest")
    cut = chain.where("not complete")
    if not cut.isEmpty():
        out = out.unionByName(_joined(spark, path, pieces, bases, cut))
    out = out.withColumn("intact", F.col("payload_digest") == F.col("digest")).drop("digest")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def _joined(spark: SparkSession, path: str, pieces: DataFrame, bases: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds magics: their pieces are read again, found by
    their digests and put together, record by record."""
    spans = cut.select(F.col("file"), F.col("off").alias("record"), (F.col("off") + F.col("length")).alias("to"))
    # every piece follows the last cut record that starts at or before it
    places = pieces.join(bases.drop("size"), ["file", "block"]).select("file", "content", (F.col("base") + F.col("at")).alias("off"))
    near = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    needed = (places.join(spans.withColumn("off", F.col("record")), ["file", "off"], "left")
              .withColumn("record", F.last("record", True).over(near)).withColumn("to", F.last("to", True).over(near))
              .where(F.col("off") < F.col("to")).select("file", "content", "off", "record"))
    needed = saved(needed)

    data = mark(open_archives(spark, path), "content", needed, "content").where("marked")
    data = data.groupBy("content").agg(F.first("piece").alias("piece"))
    names = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, digest string"

    def join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["piece"].isna().any():
            raise ValueError("a piece of a record was not found again")
        whole = MAGIC.encode().join(pdf.sort_values("off")["piece"])
        head = parse_header(whole)
        n, digest = payload_of(whole[head["content"]:head["content"] + head["length"]], head["record_type"], head["digest"])
        return pd.DataFrame([{**head, "payload_bytes": n, "payload_digest": digest}])[[x.split()[0] for x in names.split(", ")]]

    return needed.join(data, "content", "left").groupBy("file", "record").applyInPandas(join_pieces, names)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The pages written as archives and read back."""
    spark = pages.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path)
    return read_archives(spark, path)
