import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat

SF01 = "/root/testdata/sf0.01"


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, **kw)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.read_back(windows)).collect()}
    assert got == expected(rows)
    return windows.collect()


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<\\|end|> <\\\\|", "<", "|end|>", "[\\INST] [INST]] <<SYS>> <<s> </SYS>> <</SYS>>",
         "", None, "é漢🎉\n\n", "\\", "<|", "<<|>>", "[[/INST]"]


def test_control_strings_and_nulls_come_back(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "<|end|>"), (2, 1, None, "no role"), (2, None, "assistant", "first"), (3, 0, "<|text|>", "role of marks"),
             (None, 0, "assistant", "no id"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 1, "assistant|", "other role")]
    windows = check(spark, rows)
    for w in windows:
        assert w["formatted"].count("<|end|>") == w["formatted"].count("<|turn|>")
    probe = [w for w in check(spark, [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])])]
    assert "[INST]" not in probe[0]["formatted"] and "</s>" not in probe[0]["formatted"]


def test_random_texts_round_trip(spark):
    import random
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "SYS>>", "<|end|>", "a", "\n"], k=rng.randrange(12))))
            for c in range(60) for i in range(rng.randrange(1, 9))]
    check(spark, rows, budget=40, history_tokens=12)


@pytest.mark.parametrize("budget", [60, 200, 100_000])
def test_windows_keep_the_budget_and_repeat_limited_history(spark, budget):
    rows = [(c, i, "system" if i == 0 and c % 2 else ["user", "assistant"][i % 2], "x" * (13 * (i * 7 % 11))) for c in range(6) for i in range(40)]
    windows = check(spark, rows, budget=budget, history_tokens=24)
    if budget < 1000:
        assert len(windows) > 6
    by = {}
    for w in windows:
        by.setdefault(w["conv_id"], []).append(w)
    for c, own in by.items():
        own.sort(key=lambda w: w["window"])
        assert [w["window"] for w in own] == list(range(len(own)))
        for w in own:
            new = w["formatted"].count("<|end|>") - w["repeated"]
            assert new >= 1 and (w["n_tokens"] <= budget or new == 1)
            assert w["repeated"] <= chat.HISTORY_TURNS + c % 2
            if w["window"] and c % 2:
                assert w["formatted"].startswith("<|turn|>system")


def test_main_path_is_native(spark):
    rows = chat.with_probe(spark.read.parquet(f"{SF01}/conversations.parquet"))
    plan = chat.digests(chat.read_back(chat.format_conversations(rows)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0
    df = spark.createDataFrame([(1, 0, "assistant", "hi", "x", "y")], "conv_id long, turn long, role string, text string, at string, window string")
    r = chat.digests(chat.read_back(chat.format_conversations(df))).first()
    assert r["loss_chars"] == 2
    big = "z" * 2_000_000
    r = chat.digests(chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", big)], df.schema.names[:4])))).first()
    assert r["loss_chars"] == len(big)
    assert F.col is not None
