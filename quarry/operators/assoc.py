"""Association scores and their reshaping.

Scores are long tables ``(metric, feature, score)``. Pearson is one
aggregate with a ``corr`` per input. Spearman is Pearson on average ranks,
with the ranks from kernel K1, so no window ever runs over a whole column in
one task. MI (D3/D4) and distance correlation (D5) live in their own modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.params import canonical_metrics, canonical_task
from quarry.operators.kernels import Cached, bucket_count, bucketize_many, cut_points, prefix_below
from quarry.operators.prep import Prepared, numeric_features, plain_name, plain_names, prepare_for_association
from quarry.session import run_parallel

SCORE_SCHEMA = "feature string, score double"
SIGNED = ("pearson", "spearman")


def _empty_scores(spark) -> DataFrame:
    return spark.createDataFrame([], SCORE_SCHEMA)


def _stack(row_df: DataFrame, names: list[str], prefix: str = "s") -> DataFrame:
    """One-row frame with columns s0..sN-1 -> (feature, score) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{prefix}{i}").cast("double").alias("score"))
                      for i, n in enumerate(names)])
    return row_df.select(F.inline(pairs))


def target_is_constant(prep: Prepared) -> bool:
    if "target_constant" not in prep.extra:
        r = prep.frame.agg(F.min(prep.target).alias("a"), F.max(prep.target).alias("b")).first()
        prep.extra["target_constant"] = r["a"] is None or r["a"] == r["b"]
    return prep.extra["target_constant"]


# ---------------------------------------------------------------- D1
def pearson(prep: Prepared) -> DataFrame:
    """Signed Pearson r of each used input with the target, all in one
    aggregate. Constant inputs were removed by B6; a constant target scores
    0.0 (ANSI ``corr`` would divide by zero)."""
    spark = prep.frame.sparkSession
    if not prep.used:
        return _empty_scores(spark)
    if target_is_constant(prep):
        return spark.createDataFrame([(c, 0.0) for c in prep.used], SCORE_SCHEMA)
    row = prep.frame.agg(*[F.corr(c, prep.target).alias(f"s{i}") for i, c in enumerate(prep.used)])
    return _stack(row, prep.used)


# ---------------------------------------------------------------- D2
def unpivot(df: DataFrame, features, keep=(), with_buckets: bool = False) -> DataFrame:
    """Wide -> long: one row per (row, feature) with the value as ``x`` (and
    its bucket as ``xb`` when the frame carries ``<f>__b`` columns)."""
    fields = []
    for f in features:
        parts = [F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")]
        if with_buckets:
            parts.append(F.col(f + "__b").alias("xb"))
        fields.append(F.struct(*parts))
    return df.select(*keep, F.inline(F.array(*fields)))


def spearman(prep: Prepared, cuts: dict | None = None) -> DataFrame:
    """Pearson on average ranks, every input in the same stages.

    The frame is bucketed once for all columns (K1 cut points), unpivoted to
    (feature, x, rank of y), and rows are aggregated by (feature, x) so that
    equal values collapse map-side. Ranks of x per feature and of y come from
    K1; they are joined back on value, and a weighted correlation of centred
    ranks finishes (the mean rank (n+1)/2 is exact, so no cancellation).
    """
    spark = prep.frame.sparkSession
    df, y, n = prep.frame, prep.target, prep.rows_used
    if not prep.used:
        return _empty_scores(spark)
    if target_is_constant(prep) or n < 2:
        return spark.createDataFrame([(c, 0.0 if n >= 2 else None) for c in prep.used], SCORE_SCHEMA)
    if cuts is None:
        cuts = cut_points(df, prep.used + [y], bucket_count(spark, n))
    mid = (n + 1) / 2.0
    nf = len(prep.used)
    with Cached() as keep:
        b = bucketize_many(df, cuts)
        ycnt = keep(b.groupBy(F.col(y).alias("y"), F.col(y + "__b").alias("yb"))
                    .agg(F.count(F.lit(1)).alias("cnt")))
        ry = prefix_below(ycnt, [], "yb", ["y"], "cnt", rows_bound=len(cuts[y]) + 1) \
            .select("y", (F.col("below") + (F.col("cnt") + 1) / 2.0 - mid).alias("ry"), "cnt")
        syy = ry.agg(F.sum(F.col("cnt") * F.col("ry") * F.col("ry"))).first()[0]
        # each row gets its centred y rank once (a value held by many rows is
        # one row of ``ry``; AQE splits a skewed join key on the row side)
        with_ry = b.join(ry.select(F.col("y").alias(y), "ry"), y)
        long = unpivot(with_ry, prep.used, keep=["ry"], with_buckets=True)
        # per (feature, x): multiplicity and the sum of centred y ranks, in one
        # pre-aggregated shuffle
        g = keep(long.groupBy("feature", "xb", "x").agg(F.count(F.lit(1)).alias("cnt"),
                                                        F.sum("ry").alias("sry")))
        bound = nf * (max(len(v) for v in cuts.values()) + 1)
        rx = prefix_below(g, ["feature"], "xb", ["x"], "cnt", rows_bound=bound) \
            .withColumn("rx", F.col("below") + (F.col("cnt") + 1) / 2.0 - mid)
        rows = rx.groupBy("feature").agg(
            F.try_divide(F.sum(F.col("rx") * F.col("sry")),
                         F.sqrt(F.sum(F.col("cnt") * F.col("rx") * F.col("rx")) * F.lit(syy))).alias("score")
        ).collect()
    return spark.createDataFrame([(r["feature"], r["score"]) for r in rows], SCORE_SCHEMA)


# ---------------------------------------------------------------- D6, D10
def associate(df: DataFrame, target: str, task: str = "regression", metrics=("pearson", "spearman"),
              inputs=None, topk: int | None = None, mi_neighbors: int = 3, seed: int = 0,
              jitter: bool = True, dcor_sample: int | None = None,
              prepared: Prepared | None = None, key: str | None = None,
              pairwise: bool = False) -> tuple[DataFrame, Prepared]:
    """Clean (B1-B6), score every metric, and rank each metric's
    features by |score| (descending, ties by feature name), keeping the top
    ``topk`` per metric when given. Returns the long table
    ``(metric, feature, score, metric_order, rank)`` and the cleaning result.

    Rows lacking any used column are dropped (listwise). With ``pairwise`` every
    input is scored on the rows that have it and the target (B5), input by
    input; the cleaning result then describes the listwise frame.
    """
    if prepared is None and any(plain_name(c) != c for c in df.columns):
        names = {plain_name(c): c for c in df.columns}
        plain = lambda cs: None if cs is None else [plain_name(c) for c in cs]
        long, prep = associate(plain_names(df), plain_name(target), task, metrics, plain(inputs), None, mi_neighbors, seed, jitter,
                               dcor_sample, None, key and plain_name(key), pairwise)
        spelled = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        prep.frame = prep.frame.toDF(*[names[c] for c in prep.frame.columns])
        prep.target, prep.used, prep.skipped = target, [names[c] for c in prep.used], [names[c] for c in prep.skipped]
        prep.extra["key"] = key
        return rank_scores(long.drop("rank").withColumn("feature", spelled[F.col("feature")]), topk), prep
    task = canonical_task(task)
    metrics = canonical_metrics(metrics)
    prep = prepared or prepare_for_association(df, target, inputs, task, key=key)
    if pairwise:
        wanted = [c for c in (inputs if inputs is not None else numeric_features(df, target)) if c in df.columns and c != target]
        options = dict(mi_neighbors=mi_neighbors, seed=seed, jitter=jitter, dcor_sample=dcor_sample, key=key)
        rows = [r for one in run_parallel([lambda c=c: associate(df, target, task, metrics, [c], **options)[0].drop("rank").collect()
                                           for c in wanted]) for r in one]
        long = df.sparkSession.createDataFrame(rows, "metric string, feature string, score double, metric_order int")
        return rank_scores(long, topk), prep
    frame = prep.frame.persist()
    prep.frame = frame
    spark = frame.sparkSession
    cuts = None
    if "spearman" in metrics and prep.used:
        cuts = cut_points(frame, prep.used + [target], bucket_count(spark, max(prep.rows_used, 1)))
    parts = []
    for i, m in enumerate(metrics):
        if m == "pearson":
            s = pearson(prep)
        elif m == "spearman":
            s = spearman(prep, cuts)
        elif m == "mi":
            from quarry.operators.mi import mutual_information
            s = mutual_information(prep, task, k=mi_neighbors, seed=seed, jitter=jitter)
        else:
            from quarry.operators.dcor import distance_correlation
            s = distance_correlation(prep, sample=dcor_sample, seed=seed)
        parts.append(s.select(F.lit(m).alias("metric"), "feature", "score",
                              F.lit(i).alias("metric_order")))
    if not parts:
        raise ValueError("no metric requested")
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    # the score table has (metrics x inputs) rows: compute it now and release
    # the cached frame instead of keeping it alive behind a lazy plan
    rows = long.collect()
    frame.unpersist()
    long = spark.createDataFrame(rows, "metric string, feature string, score double, metric_order int")
    return rank_scores(long, topk), prep


def rank_scores(long: DataFrame, topk: int | None = None) -> DataFrame:
    """D6/D10 ordering: per metric by |score| descending, ties by feature;
    a NULL score ranks last. The window runs over one metric's features
    (a schema-sized group) and becomes a WindowGroupLimit under top-k."""
    w = Window.partitionBy("metric").orderBy(F.abs("score").desc_nulls_last(), "feature")
    out = long.withColumn("rank", F.row_number().over(w).cast("long"))
    if topk:
        out = out.where(F.col("rank") <= int(topk))
    return out


# ---------------------------------------------------------------- D7, D8, D9
def to_wide(long: DataFrame, metrics) -> DataFrame:
    """One row per feature, one column per metric (NULL where cut)."""
    metrics = list(metrics)
    return long.groupBy("feature").pivot("metric", metrics).agg(F.first("score"))


def combined(long: DataFrame) -> DataFrame:
    """Mean of |score| over the metrics present (NULLs skipped)."""
    return long.groupBy("feature").agg(F.avg(F.abs("score")).alias("combined"))


def wide_table(long: DataFrame, metrics) -> DataFrame:
    """D7 + D8 joined: feature, <metric...>, combined."""
    return to_wide(long, metrics).join(combined(long), "feature", "left")


def rank_wide(wide: DataFrame, sort_by: str = "combined", topk: int | None = None,
              by_abs: bool = False) -> DataFrame:
    """Sort by ``combined`` or one metric, descending, NULLs last; a
    metric sorts by its signed value unless ``by_abs``; then the top k."""
    if sort_by not in wide.columns:
        raise ValueError(f"sort key {sort_by!r} not in {wide.columns}")
    key = F.abs(F.col(sort_by)) if by_abs else F.col(sort_by)
    out = wide.orderBy(key.desc_nulls_last(), F.col("feature"))
    return out.limit(int(topk)) if topk else out


def to_long(long: DataFrame, topk: int | None = None) -> DataFrame:
    """Metric, feature, score in requested metric order, |score| desc."""
    out = long.where(F.col("rank") <= int(topk)) if topk else long
    return out.orderBy("metric_order", "rank").select("metric", "feature", "score")


def top_scores(long: DataFrame, metric: str, k: int | None = None) -> DataFrame:
    """One metric's top k: by |score| for signed metrics, by score for
    mi and dcor."""
    one = long.where(F.col("metric") == metric)
    key = F.abs("score") if metric in SIGNED else F.col("score")
    out = one.orderBy(key.desc_nulls_last(), "feature").select("feature", "score")
    return out.limit(int(k)) if k else out
