"""Registered queries: one per operator of the inventory.

Each entry maps a name (operator ID + short name) to a Spark callable
``(spark, sf_dir) -> DataFrame`` and, where SQL can express the result, the
equivalent DuckDB query over the same tables. Doubles are rounded to 6
decimals (plus 0.0, so -0.0 equals 0.0) on both sides; counts and positions
are BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.exprs import r6
from quarry.sources.tables import load

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rounded(df, cols=None):
    """Round the DOUBLE columns for comparison."""
    types = dict(df.dtypes)
    return df.select(*[r6(F.col(c)).alias(c) if types[c] in ("double", "float") and (cols is None or c in cols)
                       else F.col(c) for c in df.columns])


# Shared settings of the association queries.
LI_TARGET = "l_extendedprice"
LI_INPUTS = ["l_quantity", "l_discount", "l_tax"]


def sql_avg_rank(col: str, part: str | None = None) -> str:
    """DuckDB average rank of ``col`` (within ``part``)."""
    p = f"partition by {part} " if part else ""
    pc = f"partition by {part + ', ' if part else ''}{col}"
    return (f"(rank() over ({p}order by {col}) + "
            f"(count(*) over ({pc}) - 1) / 2.0)")


def sql_lineitem_scores() -> str:
    """Long score table (metric, feature, score) of pearson and spearman on
    lineitem, as a DuckDB subquery."""
    ranks = ", ".join(f"{sql_avg_rank(c)} AS r_{c}" for c in LI_INPUTS + [LI_TARGET])
    unions = []
    for c in LI_INPUTS:
        unions.append(f"SELECT 'pearson' AS metric, '{c}' AS feature, 0 AS metric_order, corr({c}, {LI_TARGET}) AS score FROM lineitem")
        unions.append(f"SELECT 'spearman', '{c}', 1, corr(r_{c}, r_{LI_TARGET}) FROM rk")
    return (f"WITH rk AS (SELECT {ranks} FROM lineitem), s AS ({' UNION ALL '.join(unions)})")


def sql_digamma(e: str) -> str:
    """DuckDB twin of functions.exprs.digamma (shift by 6 + asymptotic series)."""
    x = f"({e})::DOUBLE"
    z = f"({x} + 6.0)"
    shift = " + ".join(f"1.0 / ({x} + {i}.0)" for i in range(6))
    return (f"(ln({z}) - 0.5 / {z} - (1.0 / 12.0) / ({z} * {z}) + (1.0 / 120.0) / ({z} * {z} * {z} * {z})"
            f" - (1.0 / 252.0) / ({z} * {z} * {z} * {z} * {z} * {z})"
            f" + (1.0 / 240.0) / ({z} * {z} * {z} * {z} * {z} * {z} * {z} * {z}) - ({shift}))")


def sql_jittered(table: str, key: str, col: str, seed, extra: str = "") -> str:
    """DuckDB twin of mi.scaled_jittered: x / std_pop + 1e-10 max(1, mean|x/std|) u."""
    return f"""(SELECT t.{key}, {extra} t.{col} / s.sd + 1e-10 * greatest(1, s.ma) *
  (('0x' || substr(md5('{seed}:{col}:' || t.{key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0 * 2 - 1) AS x
  FROM {table} t, (SELECT stddev_pop({col}) AS sd, avg(abs({col} / (SELECT stddev_pop({col}) FROM {table}))) AS ma
  FROM {table}) s)"""


from quarry.plans import queries_assoc  # noqa: E402,F401
from quarry.plans import queries_split  # noqa: E402,F401
from quarry.plans import queries_eval  # noqa: E402,F401
from quarry.plans import queries_models  # noqa: E402,F401
from quarry.plans import queries_explain  # noqa: E402,F401
