"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS]. Prints one JSON line.

Every query runs over whole tables; results are forced with a collect of the
(small) result or a noop write of the (large) one.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from quarry import get_spark
    from quarry.operators import assoc, evaluate, split
    from quarry.plans.train import train_model
    from quarry.sources.tables import load

    spark = get_spark(f"local[{cpus}]", int(cpus))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-ckpt-"))

    def force(df):
        df.write.format("noop").mode("overwrite").save()

    def q_assoc():
        long, _ = assoc.associate(load(spark, sf_dir, "lineitem"), "l_extendedprice", "regression",
                                  ["pearson", "spearman"], inputs=["l_quantity", "l_discount", "l_tax"])
        assoc.rank_wide(assoc.wide_table(long, ["pearson", "spearman"]), "combined").collect()

    def q_mi_classif():
        assoc.associate(load(spark, sf_dir, "events"), "event_type", "classification", ["mi"],
                        inputs=["value", "user_id"], key="event_id")[0].collect()

    def q_dcor():
        assoc.associate(load(spark, sf_dir, "orders"), "o_totalprice", "regression", ["dcor"],
                        inputs=["o_custkey"])[0].collect()

    def q_mi_regression():
        li = load(spark, sf_dir, "lineitem")
        of = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"),
                                          F.sum("l_extendedprice").alias("sum_price"))
        assoc.associate(of, "sum_price", "regression", ["mi"], inputs=["n_lines"], key="l_orderkey")[0].collect()

    def q_knn():
        from quarry.operators.models import fit
        ev = load(spark, sf_dir, "events").withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
        s = split.split_random(ev, 0.2, 42, "event_id")
        m = fit(s.where("split = 'train'"), "event_type", ["value", "ts_s"], "classification", "knn",
                key="event_id")
        force(m.transform(s.where("split = 'test'")))

    def q_splits():
        ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
        force(split.split_stratified(ev, "event_type", 0.2, 42, "event_id"))
        force(split.split_group(ev, "user_id", 0.2, 42))
        force(split.split_time(ev, ["ts", "event_id"], 0.2))

    def q_train_linear():
        # order-level features derived from lineitem (l_orderkey is a unique key),
        # with the order priority as a categorical input
        li = load(spark, sf_dir, "lineitem")
        feats = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"),
                                             F.sum("l_quantity").alias("sum_qty"),
                                             F.avg("l_discount").alias("avg_disc"),
                                             F.sum("l_extendedprice").alias("sum_price"))
        orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
        d = feats.join(orders, "l_orderkey")
        r = train_model(d, "sum_price", ["n_lines", "sum_qty", "avg_disc", "o_orderpriority"],
                        "regression", "ridge", key="l_orderkey", seed=42)
        r.metrics.collect()
        r.cv.collect()
        r.release()

    def q_eval_auc():
        d = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
        evaluate.roc_auc(d, "quality", "n_chars", 1).collect()
        li = load(spark, sf_dir, "lineitem")
        evaluate.roc_auc(li.withColumn("y", (F.col("l_returnflag") == "R").cast("int")),
                         "y", "l_extendedprice", 1).collect()

    def order_features():
        li = load(spark, sf_dir, "lineitem")
        return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
                                            F.avg("l_discount").alias("avg_disc"), F.sum("l_extendedprice").alias("sum_price"))

    def q_boosting_permutation():
        from quarry.operators.explain import permutation_importance
        from quarry.operators.models import fit
        d = order_features().persist()
        m = fit(d, "sum_price", ["n_lines", "sum_qty", "avg_disc"], "regression", "hgb", rounds=20)
        permutation_importance(m, d, "l_orderkey", 3, 42).collect()
        d.unpersist()

    # warm-up (JIT, class loading), not timed: a whole query
    q_assoc()

    qs = {"assoc_pearson_spearman": q_assoc, "mi_classif": q_mi_classif, "mi_regression": q_mi_regression,
          "dcor": q_dcor, "knn_classify": q_knn,
          "splits": q_splits, "train_ridge_cv": q_train_linear, "roc_auc": q_eval_auc,
          "boosting_permutation": q_boosting_permutation}
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    times = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
