"""Connected components of an edge table by alternating large and small stars.

Every round points each node's neighbours at the smallest of them; all work is
grouped minima (combined before the shuffle, so a hub costs one row per task)
and equi-joins, and each round's edges are written to the shared checkpoint
folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import saved


LINKS = 100_000             # links of a partition that a round begins with, at most


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v): every neighbour v (with ``large`` only those above u) and
    u itself are linked to the smallest node around u; they may repeat."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    near = links.join(low, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _each(near, ("v", "m"), ("u", "m")).where("u <> v")


def _each(rows: DataFrame, *pairs) -> DataFrame:
    """Every row's ``pairs`` of columns as (u, v), in one pass over the rows."""
    ends = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]
    return rows.select(F.explode(F.array(*ends)).alias("p")).select("p.u", "p.v")


def _settled(links: DataFrame) -> tuple[bool, int]:
    """Whether every node has one link up and no node above another has one itself
    (the links are stars around the smallest nodes, and no round changes them), and
    the number of links."""
    seen = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("p"))
    counts = seen.groupBy("p.id").agg(F.sum("p.up").alias("up"), F.sum("p.down").alias("down"))
    r = counts.agg(F.sum("up").alias("n"), F.max(F.expr("up > 1 or (up > 0 and down > 0)")).alias("open")).first()
    return not r["open"], r["n"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (u, v): the smallest node that it
    reaches. Null ends and loops are ignored."""
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        done, n = _settled(now)
        now = now.coalesce(max(1, -(-n // LINKS)))      # no task for each of many nearly empty partitions
        if done:
            break
        now = saved(_star(_star(_each(now, ("u", "v"), ("v", "u")), True), False).distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
