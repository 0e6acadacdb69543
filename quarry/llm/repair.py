"""Operator 12: conversation repair by weighted CYK interval parsing.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Rows may be
kept (cost 0), given the role user or assistant (2) or deleted (3; blank and
duplicate rows must be), and empty user or assistant turns may be inserted
anywhere (2); a truncated row that stays adds 1. Wanted is the cheapest edit, of
equals the one whose audit (initials K, R, D, I in order) is ASCII-least.

The repair grammar is in Chomsky normal form over the language's states: N(p, q)
derives what takes the automaton from p to q, N(p, q) -> N(p, r) N(r, q) joins two
neighbouring spans, a terminal rule edits one row, and the insertion closure (the
cells of the empty span) stands on both sides of every row. A cell holds the
minimum (cost, audit). Cells are combined bottom-up, spans doubling in length:
every split of a span gives the same cell here, since joining is associative, so
one split per span is enough (tests compare all splits). Audits of equal cost
over one span are never prefixes of each other, so a least audit stays least when
another span follows.

On Spark: equal rows are counted before they are shuffled, a row is a duplicate by
a join with the least turn of its (role, text), and rows are dealt by ranges of
(conv_id, turn, role, text), so a conversation of any size is spread over tasks. A
task reduces each conversation it holds to a cell; only a task's first and last
one can reach into other tasks, and only their cells are combined (at most two
rows a task) and their states sent back. A second pass over the written rows
replays the edits.

Defined cases: a null role or text is one space (so is a null id or turn in the
damage's checksum); rows are taken by turn, nulls first, then by role, the text's
first ``HEAD`` characters and its digest; a null conv_id is a conversation of its
own; a role whose initial is none of s, u, a can only be replaced or deleted; a
conversation without rows left has zeros, an empty audit and no turns; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, saved

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
HEAD = 100                      # characters of a text by which rows of one turn are ordered
BROADCAST_ROWS = 100_000        # a measured number of rows up to which a table is broadcast
BATCH = 4 << 20                 # characters in one batch of repaired turns
# The states are 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a).
STATES, START, ENDS = 4, 0, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNC, SOUND = range(4)

Cell = dict[tuple[int, int], tuple[int, str]]


# ---- the grammar -------------------------------------------------------------

def join(a: Cell, b: Cell) -> Cell:
    """N(p, q) -> N(p, r) N(r, q): the least (cost, audit) over all r."""
    out: Cell = {}
    for (p, r), (c1, a1) in a.items():
        for q in range(STATES):
            if (r, q) in b:
                c2, a2 = b[r, q]
                best = out.get((p, q))
                if best is None or c1 + c2 < best[0] or (c1 + c2 == best[0] and a1 + a2 < best[1]):
                    out[p, q] = c1 + c2, a1 + a2
    return out


def _closure() -> Cell:
    """Cells of the empty span: insertions only."""
    out: Cell = {(p, p): (0, "") for p in range(STATES)}
    step: Cell = {(p, q): (INSERT, "I") for (p, x), q in STEP.items() if x in ROLE}
    for _ in range(STATES):
        more = join(out, step)
        for k, v in more.items():
            out[k] = min(out.get(k, v), v)
    return out


EMPTY = _closure()


def _terminal(initial: str, fault: int) -> Cell:
    """Edits of one row, insertions before and after included."""
    out: Cell = {}

    def offer(p, q, cost, edit):
        out[p, q] = min(out.get((p, q), (cost, edit)), (cost, edit))

    extra = TRUNCATED if fault == TRUNC else 0
    for p in range(STATES):
        offer(p, p, DELETE, "D")
        if fault in (TRUNC, SOUND):
            if (p, initial) in STEP:
                offer(p, STEP[p, initial], extra, "K")
            for x in ROLE:
                if (p, x) in STEP:
                    offer(p, STEP[p, x], extra + REROLE, "R")
    return join(join(EMPTY, out), EMPTY)


TERMINAL = {(i, f): _terminal(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def letter(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def parse(rows: Iterable[tuple[str, int]]) -> Cell:
    """The cell of a whole span of (letter, fault) rows, spans doubling bottom-up."""
    cells = [TERMINAL[r] for r in rows]
    if not cells:
        return EMPTY
    while len(cells) > 1:
        odd = cells[-1:] if len(cells) % 2 else []
        cells = [join(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)] + odd
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


def replay(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that ``audit`` leaves of (role, text) rows,
    from ``state`` on."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = rows[at]
            state = STEP[state, letter(role)]
        else:
            x = "a" if state == 2 else "u"
            role, text, state = ROLE[x], "" if edit == "I" else rows[at][1], STEP[state, x]
        at += edit != "I"
        yield edit, role, text


# ---- rows --------------------------------------------------------------------

WORD = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the contract's damage, by crc32(conv_id:turn) % 20: 0
    drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its
    role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                    (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("x")).where("x <> 0")
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("x") == 4, "user").otherwise(F.col("role"))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The distinct rows in order, written: conv_id, turn, role, text, copies, fault
    (of the first copy) and part (the task that holds the row)."""
    bounded_batches(rows.sparkSession)
    keys = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    rows = rows.select(*keys, F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    t = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("h", digest)
    t = t.withColumn("last", F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1))
    # texts that stand at two turns; a blank row is blank first, so it needs none
    again = F.coalesce(F.col("least") < F.col("most"), F.lit(False)) | (F.col("unnumbered") & F.col("least").isNotNull())
    seen = saved(rows.select(*keys, "role", "text").withColumn("h", digest).where(F.col("text").rlike(WORD))
                 .groupBy(F.col("conv_id").alias("c"), F.col("h").alias("g")).agg(
                     F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("unnumbered")).where(again))
    t = t.join(F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen,
               F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g")), "left")
    # nulls come first: with a null turn among them, every numbered turn is later
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("least"))), F.lit(False))
    last = F.col("last")
    fault = (F.when(last == "", BLANK).when(later, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNC).otherwise(SOUND))
    t = t.select("conv_id", "turn", "role", "text", "copies", "h", fault.cast("int").alias("fault"), F.substring("text", 1, HEAD).alias("head"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "h"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(t.select("conv_id", "turn", "role", "text", "copies", "fault", F.spark_partition_id().alias("part")))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("edge", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()),
                      ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
                      *[(c, pa.int64()) for c in COUNTS], ("opens", pa.string()), ("closes", pa.string()),
                      ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])
_SEGMENT_DDL = ("conv_id long, part int, edge boolean, cost long, audit string, cells " + _CELLS + ", "
                + ", ".join(f"{c} long" for c in COUNTS) + ", opens string, closes string, low long, high long, turns long")
REPORT = ["conv_id", "gaps", *COUNTS, "cost", "audit"]
LEGAL = ("su", "ua", "au")


class _Span:
    """What one task holds of a conversation."""

    def __init__(self, conv, part) -> None:
        self.conv, self.part = conv, part
        self.codes: list[tuple[str, int]] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.opens = self.closes = None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role, copies, fault) -> None:
        first = role[:1]
        self.opens = first if self.opens is None else self.opens
        pairs = copies - 1
        if self.closes is not None:
            self.n["illegal"] += self.closes + first not in LEGAL
        self.n["illegal"] += pairs          # a row and its copy never alternate
        self.closes = first
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        rest = BLANK if fault == BLANK else DUPLICATE
        self.codes.append((letter(role), fault))
        self.codes += [(letter(role), rest)] * pairs
        for f, n in ((fault, 1), (rest, pairs)):
            if f != SOUND:
                self.n[COUNTS[f]] += n

    def row(self, edge: bool) -> dict:
        cell = parse(self.codes)
        cost, audit = (None, None) if edge else best(cell)
        cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()] if edge else None
        return {"conv_id": self.conv, "part": self.part, "edge": edge, "cost": cost, "audit": audit, "cells": cells, **self.n,
                "opens": self.opens, "closes": self.closes, "low": self.low, "high": self.high, "turns": self.turns}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and task; a task's first and last are edges."""
    span, done, n = None, [], 0

    def out():
        return pa.RecordBatch.from_pylist(done, schema=_SEGMENT)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "copies", "fault")]
        for conv, part, turn, role, copies, fault in zip(*cols, strict=True):
            if span is None or conv != span.conv:
                if span is not None:
                    done.append(span.row(edge=n == 0))
                    n += 1
                span = _Span(conv, part)
            span.add(turn, role, copies, fault)
        if len(done) > 2000:
            yield out()
            done = []
    if span is not None:
        done.append(span.row(edge=True))
    if done:
        yield out()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the edge conversations (rows by conv_id and part), with the states
    each part is entered and left in."""
    schema = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()),
                        ("states", pa.list_(pa.struct([("part", pa.int32()), ("p", pa.int32()), ("q", pa.int32())])))])
    last, held = None, None
    for b in batches:
        done = []
        for r in b.to_pylist():
            if held is None or r["conv_id"] != last:
                if held is not None:
                    done.append(_closed(last, held))
                last, held = r["conv_id"], {"best": {START: (0, "", [])}, **dict.fromkeys(COUNTS, 0), "turns": 0, "low": None, "high": None, "closes": None}
            if held["closes"] is not None:
                held["illegal"] += held["closes"] + r["opens"] not in LEGAL
            held["closes"] = r["closes"]
            for c in COUNTS:
                held[c] += r[c]
            held["turns"] += r["turns"] - (r["low"] is not None and r["low"] == held["high"])
            held["low"] = r["low"] if held["low"] is None else held["low"]
            held["high"] = r["high"] if r["high"] is not None else held["high"]
            now: dict = {}
            for x in r["cells"]:
                if x["p"] in held["best"]:
                    cost, audit, way = held["best"][x["p"]]
                    new = (cost + x["cost"], audit + x["audit"], [*way, (r["part"], x["p"], x["q"])])
                    if x["q"] not in now or new[:2] < now[x["q"]][:2]:
                        now[x["q"]] = new
            held["best"] = now
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([_closed(last, held)], schema=schema)


def _closed(conv, held) -> dict:
    cost, audit, way = min(held["best"][q] for q in ENDS if q in held["best"])
    gaps = 0 if held["low"] is None else held["high"] - held["low"] + 1 - held["turns"]
    return {"conv_id": conv, "gaps": gaps, **{c: held[c] for c in COUNTS}, "cost": cost, "audit": audit,
            "states": [{"part": a, "p": p, "q": q} for a, p, q in way]}


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of each conversation, in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("text", pa.string()), ("shared", pa.bool_())])
    now, rows, codes, out, size = None, [], [], [], 0

    def repaired():
        conv, part, p, q = now
        cell = parse(codes)
        audit = best(cell)[1] if p is None else cell[p, q][1]
        seq = 0
        for edit, role, text in replay(rows, audit, START if p is None else p):
            yield {"conv_id": conv, "part": part, "seq": seq, "edit": edit, "role": role, "text": text, "shared": p is not None}
            seq += 1

    def emit(last: bool):
        nonlocal out, size
        if now is not None:
            for x in repaired():
                out.append(x)
                size += len(x["text"]) + 64
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if last and out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "part", "p", "q", "role", "text", "copies", "fault")]
        for conv, part, p, q, role, text, copies, fault in zip(*cols, strict=True):
            if now is None or conv != now[0]:
                yield from emit(False)
                now, rows, codes = (conv, part, p, q), [], []
            rest = BLANK if fault == BLANK else DUPLICATE
            rows += [(role, text)] * copies
            codes += [(letter(role), fault)] + [(letter(role), rest)] * (copies - 1)
    yield from emit(True)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (``REPORT``, one row per conversation with rows) and repaired turns:
    conv_id, part and seq (their order), edit (K, R or I), role, text, and shared
    (the conversation reaches over several parts)."""
    t = ordered(rows)
    segments = saved(t.select("conv_id", "part", "turn", "role", "copies", "fault").mapInArrow(_segments, _SEGMENT_DDL))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    inner = segments.where("not edge").select("conv_id", gaps, *COUNTS, "cost", "audit")
    edges = segments.where("edge").drop("cost", "audit").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    edges = saved(edges.mapInArrow(_combined, "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in COUNTS)
                                   + ", cost long, audit string, states array<struct<part:int,p:int,q:int>>"))
    # at most two conversations a task: bounded by the number of tasks
    over = (edges.where(F.size("states") > 1).select(F.col("conv_id").alias("c"), F.explode("states").alias("x"))
            .select("c", F.col("x.part").alias("in"), F.col("x.p").alias("p"), F.col("x.q").alias("q")))
    t = t.join(F.broadcast(over), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("in")), "left")
    turns = t.select("conv_id", "part", "p", "q", "role", "text", "copies", "fault").mapInArrow(
        _turns, "conv_id long, part int, seq long, edit string, role string, text string, shared boolean")
    return inner.union(edges.select(REPORT)), turns


_HASHED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int64()),
                     ("role", pa.string()), ("text", pa.string())])
_HASHED_DDL = "conv_id long, repaired_sha256 string, part int, seq long, role string, text string"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the turns ``role:text`` joined by newlines, of conversations whose
    turns follow each other; no text is held. Shared ones pass as they are."""
    last, h, done = None, None, []

    def close():
        done.append({"conv_id": last, "repaired_sha256": h.hexdigest()})

    for b in batches:
        for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "part", "seq", "role", "text", "shared")], strict=True):
            conv, part, seq, role, text, shared = r
            if h is not None and (shared or conv != last):
                close()
                h = None
            if shared:
                done.append({"conv_id": conv, "part": part, "seq": seq, "role": role, "text": text})
                continue
            if h is None:
                last, h = conv, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_HASHED)
            done.clear()
    if h is not None:
        close()
        yield pa.RecordBatch.from_pylist(done, schema=_HASHED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of every conversation that has turns. One that
    reaches over several parts is hashed in one stream (a digest has one state),
    turn by turn, and no text is held."""
    found = saved(turns.mapInArrow(_hashes, _HASHED_DDL))
    shared = (found.where("part is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
              .select("conv_id", "part", "seq", "role", "text", F.lit(False).alias("shared")).mapInArrow(_hashes, _HASHED_DDL))
    own = found.where("part is null")
    return own.union(shared).select("conv_id", "repaired_sha256")


NO_TURNS = hashlib.sha256(b"").hexdigest()


def repair_report(rows: DataFrame) -> DataFrame:
    """Damage, repair and digest: one row per conversation of ``rows``."""
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    reports, turns = repair(damaged(rows))
    found = reports.withColumnRenamed("conv_id", "r")
    hashed = digests(turns).withColumnRenamed("conv_id", "d")
    out = (ids.join(found, F.col("conv_id").eqNullSafe(F.col("r")), "left")
           .join(hashed, F.col("conv_id").eqNullSafe(F.col("d")), "left"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(NO_TURNS)).alias("repaired_sha256"))


def _sql() -> str:
    """The same rows in SQL: the least edits of every prefix of a conversation, by the
    state they end in (s0 ... s3: cost c, audit a, turns t)."""
    def edit(state, cost, letter, turn=None):
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {f'[{turn}]' if turn else '[]::VARCHAR[]'}}} END"

    def when(cond, e):
        return f"CASE WHEN {cond} THEN {e} END"

    def least(*es):
        return f"list_min([{', '.join(es)}])"

    kept, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    stays = "fault IN ('t', '')"
    keep = lambda s, i: when(f"{stays} AND left(role, 1) = '{i}'", edit(s, "x", "K", kept))
    rerole = lambda s, turn: when(stays, edit(s, "2 + x", "R", turn))
    row = {
        "n0": edit("s0", 3, "D"),
        "n1": least(edit("s1", 3, "D"), keep("s0", "s")),
        "n2": least(edit("s2", 3, "D"), *[keep(s, "u") for s in ("s0", "s1", "s3")], *[rerole(s, user) for s in ("s0", "s1", "s3")]),
        "n3": least(edit("s3", 3, "D"), keep("s2", "a"), rerole("s2", assistant)),
    }
    insert_user = least("n2", *[edit(s, 2, "I", "'user:'") for s in ("n0", "n1", "n3")])
    insert_assistant = least("n3", edit("m2", 2, "I", "'assistant:'"))
    crc = ("xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda z: ascii(z)::BIGINT), lambda c, b: "
           "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), "
           "4294967295::BIGINT))")
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
x AS (SELECT *, {crc} % 20 AS x FROM k),
d AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN ''
  WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE x WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM x WHERE x <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM r),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
s AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]),
    {{'c': 2::BIGINT, 'a': 'I', 't': ['user:']}}, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} FROM s
  UNION ALL SELECT conv_id, pos, n0, n1, m2, {insert_assistant} FROM (SELECT *, {insert_user} AS m2 FROM (
    SELECT conv_id, pos, {', '.join(f'{e} AS {n}' for n, e in row.items())} FROM (
      SELECT p.conv_id, f.pos, s0, s1, s2, s3, role, text, fault, CASE fault WHEN 't' THEN 1 ELSE 0 END AS x
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1)))),
e AS (SELECT p.conv_id, least(s0, coalesce(s3, s0)) AS b FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = s.n),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM i LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""


SQL = _sql()
