"""Kernels that Spark has no single operator for.

K1  ``prefix_below`` / ``average_ranks``: running sums and positions over a
    global order without a single-task window. Values are cut into buckets
    by approximate quantiles (a bounded list of cut points), per-bucket
    totals (a bounded table) give each bucket's offset, and a window inside
    each bucket finishes the job. Equal values always share a bucket, so
    ties are exact. Every bucket holds about ``rows / buckets`` rows, so no
    task sees more than its share however large the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest number of buckets per ordered column; with it the per-bucket table
# stays far below the broadcast threshold (groups x buckets rows).
MAX_BUCKETS = 65_536
DEFAULT_ROWS_PER_BUCKET = 2_000_000
BROADCAST_ROWS = 2_000_000


class Cached:
    """Intermediates that are read more than once (K1 reads its input for the
    bucket totals and again for the join back) are persisted here, memory
    first and spilling to disk, and released together when the small
    result has been computed."""

    def __init__(self):
        self.frames = []

    def __call__(self, df: DataFrame) -> DataFrame:
        from pyspark import StorageLevel
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.frames.append(df)
        return df

    def release(self):
        for f in self.frames:
            f.unpersist()
        self.frames = []

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.release()


def rows_per_bucket(spark) -> int:
    return int(spark.conf.get("spark.quarry.rowsPerBucket", str(DEFAULT_ROWS_PER_BUCKET)))


def bucket_count(spark, n_rows: int) -> int:
    """Enough buckets to keep every bucket near ``rows_per_bucket`` rows and
    to use every shuffle partition."""
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:
        parts = 200
    b = max(parts, math.ceil(n_rows / max(1, rows_per_bucket(spark))))
    return int(max(1, min(MAX_BUCKETS, b, max(1, n_rows // 2))))


def cut_points(df: DataFrame, cols, n_buckets: int) -> dict[str, list[float]]:
    """Approximate quantile cuts for each column, one pass for all columns.
    The driver receives ``len(cols) * (n_buckets - 1)`` numbers at most."""
    cols = list(cols)
    if n_buckets <= 1 or not cols:
        return {c: [] for c in cols}
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(cols, probs, 1.0 / (4 * n_buckets))
    out = {}
    for c, q in zip(cols, qs):
        vals = sorted(set(v for v in q if v is not None and not math.isnan(v)
                          and not math.isinf(v)))
        out[c] = vals
    return out


def bucketize(df: DataFrame, col: str, cuts, out: str) -> DataFrame:
    """Bucket number of ``col`` for sorted ``cuts`` (bucket i holds
    cuts[i-1] <= v < cuts[i]); a binary search on the JVM side."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer
    splits = [-math.inf] + list(cuts) + [math.inf]
    tmp = f"{out}__d"
    b = Bucketizer(splits=splits, inputCol=col, outputCol=tmp, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(tmp).cast("int")).drop(tmp)


def bucketize_many(df: DataFrame, cuts: dict[str, list[float]], suffix: str = "__b") -> DataFrame:
    """``bucketize`` for several columns in one transform."""
    from pyspark.ml.feature import Bucketizer
    real = {c: v for c, v in cuts.items() if v}
    for c, v in cuts.items():
        if not v:
            df = df.withColumn(c + suffix, F.lit(0))
    if not real:
        return df
    names = list(real)
    b = Bucketizer(splitsArray=[[-math.inf] + real[c] + [math.inf] for c in names],
                   inputCols=names, outputCols=[c + suffix + "d" for c in names],
                   handleInvalid="keep")
    df = b.transform(df)
    for c in names:
        df = df.withColumn(c + suffix, F.col(c + suffix + "d").cast("int")).drop(c + suffix + "d")
    return df


def bounded_broadcast(df: DataFrame, rows_bound: int) -> DataFrame:
    """Hint a broadcast only when the caller can prove the row bound and it
    is small; otherwise AQE decides from the real size at run time."""
    return F.broadcast(df) if rows_bound <= BROADCAST_ROWS else df


def null_safe_join(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` in which NULL meets NULL; the right side's copies
    of the columns are dropped. Used wherever a group or bucket may be NULL,
    so that its rows are never lost."""
    r = right.select(*[F.col(c).alias(f"__ns_{i}") for i, c in enumerate(cols)],
                     *[c for c in right.columns if c not in cols])
    on = None
    for i, c in enumerate(cols):
        e = left[c].eqNullSafe(r[f"__ns_{i}"])
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*[f"__ns_{i}" for i in range(len(cols))])


def prefix_below(df: DataFrame, group_cols, bucket_col: str, order_cols, weight,
                 out: str = "below", rows_bound: int | None = None) -> DataFrame:
    """K1: for each row, the sum of ``weight`` over rows of its group that
    come strictly before it in ``order_cols`` order.

    ``bucket_col`` must be a non-decreasing function of the order (as from
    ``bucketize``), and rows must be distinct on (group, order) -- aggregate
    duplicates first. ``rows_bound`` bounds groups x buckets; it decides
    whether the offset table is broadcast. ``weight`` may be a list of
    columns; then ``out`` is a list of output names of the same length.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols) if not isinstance(order_cols, str) else [order_cols]
    many = isinstance(weight, (list, tuple))
    weights = list(weight) if many else [weight]
    outs = list(out) if many else [out]
    d = df
    for i, w in enumerate(weights):
        d = d.withColumn(f"__w{i}", F.col(w) if isinstance(w, str) else w)
    wn = [f"__w{i}" for i in range(len(weights))]
    totals = d.groupBy(*group_cols, bucket_col).agg(*[F.sum(w).alias(f"{w}t") for w in wn])
    over_buckets = Window.partitionBy(*group_cols).orderBy(bucket_col) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, bucket_col,
                            *[F.coalesce(F.sum(f"{w}t").over(over_buckets), F.lit(0)).alias(f"{w}o")
                              for w in wn])
    if rows_bound is not None:
        offsets = bounded_broadcast(offsets, rows_bound)
    d = null_safe_join(d, offsets, group_cols + [bucket_col])
    inside = Window.partitionBy(*group_cols, bucket_col).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, -1)
    for w, o in zip(wn, outs):
        d = d.withColumn(o, F.col(f"{w}o") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return d.drop(*wn, *[f"{w}o" for w in wn])


def average_ranks(values: DataFrame, value_col: str, group_cols=(), count_col: str | None = None,
                  cuts=None, n_rows: int | None = None, groups_bound: int | None = 1,
                  out: str = "rank") -> DataFrame:
    """K1 applied to ranks: average rank (1-based, ties share the mean of
    their positions) of every distinct value of ``value_col`` in each group.

    ``values`` holds rows (``count_col`` None) or distinct values with a
    multiplicity column. Duplicate values are aggregated first, so a value
    held by a third of all rows is a single row here. ``cuts`` may be given
    (e.g. computed for many columns in one pass); otherwise they are drawn
    from the distinct values. Returns (group..., value, cnt, below, rank).
    """
    spark = values.sparkSession
    group_cols = list(group_cols)
    w = F.count(F.lit(1)) if count_col is None else F.sum(count_col)
    distinct = values.groupBy(*group_cols, value_col).agg(w.cast("long").alias("cnt"))
    if cuts is None:
        if n_rows is None:
            n_rows = distinct.count()
        cuts = cut_points(distinct, [value_col], bucket_count(spark, n_rows))[value_col]
    b = bucketize(distinct, value_col, cuts, "__bucket")
    r = prefix_below(b, group_cols, "__bucket", [value_col], "cnt", out="below",
                     rows_bound=None if groups_bound is None else groups_bound * (len(cuts) + 1))
    return r.withColumn(out, F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)).drop("__bucket")


def hash_digits(spark, n_rows: int) -> int:
    """Leading hex digits of an md5 that cut ``n_rows`` rows into buckets of at
    most ``rows_per_bucket`` rows (the digits are uniform)."""
    b = max(2, math.ceil(n_rows / max(1, rows_per_bucket(spark))), min(256, n_rows // 2))
    return max(1, math.ceil(math.log(b, 16)))


def require_keys(df: DataFrame, cols) -> int:
    """The number of rows, after making sure that no row has a NULL in ``cols``:
    a row without its key has no place in a reproducible order."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"null{i}") for i, c in enumerate(cols)]).first()
    bad = {c: row[f"null{i}"] for i, c in enumerate(cols) if row[f"null{i}"]}
    if bad:
        raise ValueError(f"rows with a NULL order value: {bad}")
    return int(row["n"])


def hash_positions(df: DataFrame, seed, key_cols, group_cols=(), out: str = "pos",
                   n_rows: int | None = None, n_groups: int | None = None) -> DataFrame:
    """K1 for a reproducible random order: 0-based position of each row in
    md5(seed:key) order within its group (NULL is a group of its own).

    The md5 text is uniform, so its first hex digits are already balanced
    buckets in the same order: no quantile pass is needed. ``key_cols`` must
    identify rows (within a group). ``n_rows`` is measured when not given;
    ``n_groups`` bounds the offset table when known.
    """
    from quarry.functions.exprs import order_key
    spark = df.sparkSession
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    n = n_rows if n_rows is not None else require_keys(df, key_cols)
    digits = hash_digits(spark, n)
    d = df.withColumn("__h", order_key(seed, *key_cols)) \
          .withColumn("__hb", F.substring("__h", 1, digits))
    groups = 1 if not group_cols else n_groups
    r = prefix_below(d, list(group_cols), "__hb", ["__h", *key_cols], F.lit(1),
                     out=out, rows_bound=None if groups is None else groups * 16 ** digits)
    return r.withColumn(out, F.col(out).cast("long")).drop("__h", "__hb")


def last_of_first(df: DataFrame, h, quotas: DataFrame, group_col: str, n_rows: int) -> DataFrame:
    """(group, last): the largest of the ``quota`` smallest values of the md5
    column ``h`` in every group of ``quotas`` (group, quota > 0).

    Rows are counted per md5 prefix (partial sums before a small shuffle); only
    the rows of each group's boundary prefix are ordered. So a split needs no
    shuffle of the table: a row is inside when its md5 is not above ``last``.
    """
    digits = hash_digits(df.sparkSession, n_rows)
    d = df.select(group_col, h.alias("__h")).withColumn("__p", F.substring("__h", 1, digits))
    counts = d.groupBy(group_col, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(group_col).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__below", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    edge = null_safe_join(counts, quotas, [group_col]).where(
        (F.col("__below") < F.col("quota")) & (F.col("quota") <= F.col("__below") + F.col("__c")))
    edge = edge.select(group_col, "__p", (F.col("quota") - F.col("__below")).alias("__nth"))
    rows = null_safe_join(d, edge, [group_col, "__p"])
    place = F.row_number().over(Window.partitionBy(group_col).orderBy("__h"))
    return rows.withColumn("__r", place).where(F.col("__r") == F.col("__nth")).select(group_col, F.col("__h").alias("last"))


def order_values(df: DataFrame, cols) -> list[Column]:
    """``cols`` as columns whose literals compare exactly (times as integers)."""
    types = dict(df.dtypes)
    out = []
    for c in cols:
        if types[c].startswith("timestamp"):
            out.append(F.unix_micros(F.col(c).cast("timestamp")))
        elif types[c] == "date":
            out.append(F.unix_date(F.col(c)))
        else:
            out.append(F.col(c))
    return out


def nth_values(df: DataFrame, cols, places) -> dict[int, tuple]:
    """The order tuple (``order_values``) of the rows at the 0-based ``places`` of
    the table ordered by ``cols``. Only the order columns are sorted (by ranges
    of the whole tuple, so one hot time value is spread by its tie-breakers);
    the driver reads a count per range and the asked rows."""
    from quarry.session import cut_lineage
    vals = [v.alias(f"v{i}") for i, v in enumerate(order_values(df, cols))]
    names = [f"v{i}" for i in range(len(vals))]
    s = cut_lineage(df.select(*vals).orderBy(*names))
    s = s.select("*", F.spark_partition_id().alias("__part"),
                 F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = sorted((r["__part"], r["n"]) for r in s.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    out = {}
    for place in places:
        rest = place
        for part, n in sizes:
            if rest < n:
                row = s.where((F.col("__part") == part) & (F.col("__at") == rest)).first()
                out[place] = tuple(row[c] for c in names)
                break
            rest -= n
    return out


def order_number(df: DataFrame, col: str) -> Column:
    """A DOUBLE with the same order as ``col`` (numbers as is, timestamps as
    microseconds since the epoch, exact below 2^53)."""
    t = dict(df.dtypes)[col]
    if t.startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if t == "date":
        return F.unix_date(F.col(col)).cast("double")
    return F.col(col).cast("double")


def ordered_positions(df: DataFrame, order_cols, group_cols=(), out: str = "pos",
                      n_rows: int | None = None, n_groups: int | None = None) -> DataFrame:
    """K1 for an explicit order: 0-based position of each row ordered by
    ``order_cols`` (the first must be numeric or a timestamp; the rest break
    ties and must make rows distinct) within its group."""
    spark = df.sparkSession
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    first = order_cols[0]
    d = df.withColumn("__o", order_number(df, first))
    if n_rows is None:
        n_rows = df.count()
    cuts = cut_points(d, ["__o"], bucket_count(spark, n_rows))["__o"]
    d = bucketize(d, "__o", cuts, "__ob")
    groups = 1 if not group_cols else n_groups
    r = prefix_below(d, list(group_cols), "__ob", ["__o", *order_cols], F.lit(1), out=out,
                     rows_bound=None if groups is None else groups * (len(cuts) + 1))
    return r.withColumn(out, F.col(out).cast("long")).drop("__o", "__ob")
