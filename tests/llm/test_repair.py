import hashlib
import itertools
import random

import duckdb
from pyspark.sql import functions as F

from quarry.llm import repair

ROWS = "conv_id long, turn long, role string, text string, part string, seq string"


def all_edits(rows):
    """Least (cost, audit) over every edit with at most two insertions at a place."""
    best = None
    choices = ["D" if f in (repair.BLANK, repair.DUPLICATE) else "DKR" for _, f in rows]
    for edits in itertools.product(*choices):
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            for roles in itertools.product("ua", repeat=edits.count("R")):
                out, cost, audit, r = "", 0, "", iter(roles)
                # an inserted turn takes whichever role fits, so try by the pattern's next letter
                for k in range(len(rows) + 1):
                    for _ in range(ins[k]):
                        out += "a" if out[-1:] == "u" else "u"
                        cost, audit = cost + 2, audit + "I"
                    if k < len(rows):
                        e = edits[k]
                        audit += e
                        cost += {"K": 0, "R": 2, "D": 3}[e] + (e != "D" and rows[k][1] == repair.TRUNC)
                        out += "" if e == "D" else rows[k][0] or "x" if e == "K" else next(r)
                body = out[1:] if out[:1] == "s" else out
                if (out == "" or (body and body == "ua" * (len(body) // 2))) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def every_split(rows):
    """CYK over all intervals and all splits."""
    cells = {(i, i + 1): repair.TERMINAL[r] for i, r in enumerate(rows)}
    for size in range(2, len(rows) + 1):
        for i in range(len(rows) - size + 1):
            cell = {}
            for m in range(i + 1, i + size):
                for k, v in repair.join(cells[i, m], cells[m, i + size]).items():
                    cell[k] = min(cell.get(k, v), v)
            cells[i, i + size] = cell
    return cells[0, len(rows)] if rows else repair.EMPTY


def test_parse_matches_all_edits_and_all_splits():
    rng = random.Random(5)
    for n in range(5):
        for _ in range(12 if n < 4 else 4):
            rows = [(rng.choice(["s", "u", "a", ""]), rng.randrange(4)) for _ in range(n)]
            assert repair.best(repair.parse(rows)) == all_edits(rows), rows
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", ""]), rng.randrange(4)) for _ in range(rng.randrange(1, 14))]
        assert repair.parse(rows) == every_split(rows), rows


def oracle(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", [list(r) for r in rows])
    return sorted(con.execute(f"select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from ({repair.SQL})").fetchall(), key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows], ROWS)
    out = repair.repair_report(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_odd_rows_match_sql(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "One.", "Two", "Three!", "One.", "wé \U0001f389.", "x" * 50_000 + "?", "a\x0b", "\x85"]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in (None, 1, 2, 3, 9007199254740993)
            for t in (None, None, 0, 1, 1, 2, 5, 9007199254740993 % 40)]
    rows += [(4, 0, "user", "same.")] * 30 + [(5, None, "user", "no turn.")] * 2 + [(k, 0, "user", "a.") for k in range(100, 160)]
    assert got(spark, rows) == oracle(rows)
    assert got(spark, []) == []


def test_a_conversation_over_many_tasks(spark):
    """One conversation with most rows, and some that only it neighbours."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "again.", ""])) for t in range(900)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (1, 6, 8, 9) for t in range(6)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = repair.ordered(repair.damaged(spark.createDataFrame([(*r, "", "") for r in rows], ROWS))).where("conv_id = 7")
        assert parts.select("part").distinct().count() > 2
        assert got(spark, rows) == oracle(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Yes?"), (1, 2, "user", "Cut off"), (1, 2, "user", "Cut off"), (1, 3, "tool", "7.")]
    reports, turns = repair.repair(spark.createDataFrame([(*r, "", "") for r in rows], ROWS))
    out = [tuple(r) for r in turns.orderBy("part", "seq").select("edit", "role", "text").collect()]
    assert out == [("K", "system", "Be brief."), ("I", "user", ""), ("K", "assistant", "Yes?"), ("K", "user", "Cut off"), ("R", "assistant", "7.")]
    r = reports.first()
    assert (r["cost"], r["audit"], r["duplicate"], r["truncated"]) == (2 + 1 + 3 + 2, "KIKKDR", 1, 1)
    digest = repair.digests(turns).first()["repaired_sha256"]
    assert digest == hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in out).encode()).hexdigest()


def test_sound_conversations_stay_as_they_are(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.", "", "") for c in range(20) for t in range(4)]
    reports, turns = repair.repair(spark.createDataFrame(rows, ROWS))
    assert reports.where(F.col("cost") > 0).count() == 0 and turns.count() == 80
