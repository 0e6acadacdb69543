"""Operator 4: chat formatting into budgeted windows, DataFrame functions only.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Control strings inside
roles and texts (the template's own and those of common chat formats) get a
backslash after their first character, one more if they already carry some, so
``unescape`` restores every text exactly and the marks never occur by accident.

Prefix sums of turn tokens choose the windows. With ``room`` tokens left beside
the system turn and the history allowance, the prefix axis is cut every ``room``
tokens: turns that lie in one cell share a window, a turn across a cut has its
own. So no window exceeds the budget unless one turn alone does (turns are never
cut), and no state runs along a conversation. Every window after the first
repeats a leading system turn and at most ``HISTORY_TURNS`` turns (and
``HISTORY_TOKENS`` tokens) before it. Loss spans cover the texts of assistant
turns that the window does not repeat, so each target counts once.

One shuffle by conversation serves all windows and groupings.

Defined cases: a null text or role is empty; turns are ordered by turn (null
first), then role and text, so ties and repeated rows have one order; a null
conv_id is a conversation of its own; a conversation without assistant has empty
loss; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings are escaped: "<|...", <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
ANGLE, SQUARE = r"\||/?s>|</?SYS>>", r"/?INST\]"

BUDGET = 1024
HISTORY_TURNS, HISTORY_TOKENS = 2, 192
SYSTEM, TARGET = "system", "assistant"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, rf"<(\\*)({ANGLE})", r"<\\$1$2")
    return F.regexp_replace(c, rf"\[(\\*)({SQUARE})", r"[\\$1$2")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, rf"<\\(\\*)({ANGLE})", r"<$1$2")
    return F.regexp_replace(c, rf"\[\\(\\*)({SQUARE})", r"[$1$2")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn, estimated: a token per four bytes and four for its marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def format_conversations(rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                         history_tokens: int = HISTORY_TOKENS, tokens=turn_tokens) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_tokens, repeated (how many
    of its first turns repeat earlier ones) and loss_spans (start from 0, length;
    in characters of ``formatted``)."""
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("at", F.row_number().over(order) - 1)
    t = t.withColumn("is_system", (F.col("at") == 0) & (F.col("role") == SYSTEM))
    t = t.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))).withColumn("body", escape(F.col("text")))
    t = t.withColumn("segment", F.concat("head", "body", F.lit(END))).withColumn("tokens", tokens(F.col("text")))
    after = Window.partitionBy("conv_id").orderBy("at")
    t = (t.withColumn("system_segment", F.max(F.when(F.col("is_system"), F.col("segment"))).over(conv))
         .withColumn("system_tokens", F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(conv))
         .withColumn("ends", F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(after))
         .withColumn("starts", F.col("ends") - F.when(F.col("is_system"), 0).otherwise(F.col("tokens")))
         .withColumn("room", F.greatest(F.lit(budget - history_tokens) - F.col("system_tokens"), F.lit(1))))
    t = t.withColumn("cell", F.struct(F.floor(F.col("starts") / F.col("room")).alias("a"), F.floor((F.col("ends") - 1) / F.col("room")).alias("b")))
    first = F.col("at") <= F.when(F.col("system_segment").isNotNull(), 1).otherwise(0)
    t = t.withColumn("opens", F.when(first, False).otherwise(F.col("cell") != F.lag("cell").over(after)))
    t = t.withColumn("window", F.sum(F.col("opens").cast("int")).over(after))
    # a window's first turn brings the system turn and the limited history
    recent = F.collect_list(F.struct("segment", "starts", "tokens", "is_system")).over(after.rowsBetween(-history_turns, -1))
    t = t.withColumn("recent", F.filter(recent, lambda x: ~x["is_system"] & (F.col("starts") - x["starts"] <= history_tokens)))
    opening = F.col("opens")
    t = t.withColumn("lead", F.when(opening, F.concat(F.coalesce("system_segment", F.lit("")), F.array_join(F.transform("recent", lambda x: x["segment"]), ""))).otherwise(""))
    t = t.withColumn("n_lead", F.when(opening, F.size("recent") + F.col("system_segment").isNotNull().cast("int")).otherwise(0))
    t = t.withColumn("lead_tokens", F.when(opening, F.col("system_tokens") + F.aggregate("recent", F.lit(0).cast("bigint"), lambda s, x: s + x["tokens"])).otherwise(0))
    part = F.concat("lead", "segment")
    inside = Window.partitionBy("conv_id", "window").orderBy("at")
    t = t.withColumn("from", F.sum(F.length(part)).over(inside) - F.length("segment") + F.length("head"))
    t = t.withColumn("span", F.when(F.col("role") == TARGET, F.struct(F.col("from").alias("start"), F.length("body").cast("bigint").alias("length"))))
    ordered = F.array_sort(F.collect_list(F.struct("at", part.alias("part"), "span")))
    w = t.groupBy("conv_id", "window").agg(
        ordered.alias("parts"), F.sum(F.col("tokens") + F.col("lead_tokens")).alias("n_tokens"),
        F.sum("n_lead").cast("int").alias("repeated"))
    spans = F.filter(F.transform("parts", lambda x: x["span"]), lambda x: x.isNotNull())
    return w.select("conv_id", "window", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"),
                    "n_tokens", "repeated", spans.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), targets (texts under the loss mask) and
    formatted_chars of each conversation, from the formatted windows alone."""
    pieces = F.split("formatted", r"<\|end\|>")
    new = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    text_from = len(TEXT)

    def turn(p: Column) -> Column:
        cut = F.instr(p, TEXT)
        return F.struct(unescape(F.substring(p, F.lit(len(TURN) + 1), cut - 1 - len(TURN))).alias("role"),
                        unescape(F.substring(p, cut + text_from, F.length(p))).alias("text"))

    targets = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))))
    one = windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))
    all_ = F.array_sort(F.collect_list(F.struct("window", "turns", "targets")))
    return (one.groupBy("conv_id").agg(all_.alias("w"), F.sum("chars").alias("formatted_chars"))
            .select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
                    F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"), "formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` found."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are control strings."""
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                              "conv_id bigint, turn bigint, role string, text string")
    return rows.unionByName(probe)


# DuckDB: the same template, escape and window rule.
SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM rows_),
e AS (SELECT *, (place = 0 AND role = '{SYSTEM}') AS is_system, (strlen(text) + 3) // 4 + 4 AS tokens,
  {len(TURN + TEXT + END)} + length(regexp_replace(regexp_replace(role, '<(\\*)({ANGLE})', '<\\\1\2', 'g'), '\[(\\*)({SQUARE})', '[\\\1\2', 'g'))
  + length(regexp_replace(regexp_replace(text, '<(\\*)({ANGLE})', '<\\\1\2', 'g'), '\[(\\*)({SQUARE})', '[\\\1\2', 'g')) AS chars FROM n),
s AS (SELECT *, max(CASE WHEN is_system THEN chars END) OVER (PARTITION BY conv_id) AS system_chars,
  greatest({BUDGET - HISTORY_TOKENS} - max(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 1) AS room,
  sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place) AS ends FROM e),
p AS (SELECT *, ends - CASE WHEN is_system THEN 0 ELSE tokens END AS starts FROM s),
c AS (SELECT *, floor(starts / room) AS cell_a, floor((ends - 1) / room) AS cell_b FROM p),
o AS (SELECT *, place > (CASE WHEN system_chars IS NULL THEN 0 ELSE 1 END)
  AND (cell_a <> lag(cell_a) OVER (PARTITION BY conv_id ORDER BY place) OR cell_b <> lag(cell_b) OVER (PARTITION BY conv_id ORDER BY place)) AS opens FROM c),
h AS (SELECT f.conv_id, sum(b.chars) AS history_chars FROM o f JOIN o b ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.opens
  AND b.place BETWEEN f.place - {HISTORY_TURNS} AND f.place - 1 AND NOT b.is_system AND f.starts - b.starts <= {HISTORY_TOKENS} GROUP BY f.conv_id),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = '{TARGET}' THEN text END, '' ORDER BY place), '') AS loss,
  sum(chars) + sum(CASE WHEN opens THEN coalesce(system_chars, 0) ELSE 0 END) AS chars FROM o GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(g.chars + coalesce(h.history_chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN h ON g.conv_id IS NOT DISTINCT FROM h.conv_id
"""
