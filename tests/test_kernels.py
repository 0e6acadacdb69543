import numpy as np
from brute import avg_rank
from pyspark.sql import functions as F

from quarry.operators.kernels import average_ranks, hash_positions, ordered_positions


def test_average_ranks_match_definition(spark, events):
    r = average_ranks(events.select("value"), "value").toPandas()
    vals = events.select("value").toPandas()["value"].values
    ref = dict(zip(vals, avg_rank(vals)))
    assert len(r) == len(set(vals))
    for v, rk in zip(r["value"], r["rank"]):
        assert abs(rk - ref[v]) < 1e-9


def test_hash_positions_are_md5_order(spark, events):
    p = hash_positions(events.select("event_id"), 42, "event_id").toPandas()
    import hashlib
    ref = sorted(events.select("event_id").toPandas()["event_id"],
                 key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    got = p.sort_values("pos")["event_id"].tolist()
    assert got == ref
    assert sorted(p["pos"]) == list(range(len(p)))


def test_ordered_positions_per_group(spark, events):
    p = ordered_positions(events.select("event_id", "ts", "event_type"), ["ts", "event_id"],
                          group_cols=["event_type"]).toPandas()
    for _, g in p.groupby("event_type"):
        assert g.sort_values(["ts", "event_id"])["pos"].tolist() == list(range(len(g)))


def test_same_result_for_1_and_many_partitions(spark, events):
    a = hash_positions(events.select("event_id").coalesce(1), 7, "event_id").orderBy("pos").toPandas()
    b = hash_positions(events.select("event_id").repartition(16), 7, "event_id").orderBy("pos").toPandas()
    assert a["event_id"].tolist() == b["event_id"].tolist()


def test_hot_value_is_one_row(spark, events):
    # a value held by a third of all rows collapses before ranking
    hot = events.select(F.when(F.col("event_id") % 3 == 0, F.lit(1.0)).otherwise(F.col("value")).alias("v"))
    r = average_ranks(hot, "v").toPandas()
    vals = hot.toPandas()["v"].values
    ref = dict(zip(vals, avg_rank(vals)))
    assert np.allclose([ref[v] for v in r["v"]], r["rank"])
