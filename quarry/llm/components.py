"""Connected components of a graph too large for one machine: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, drop


def _stars(edges: DataFrame) -> bool:
    """Whether every u hangs on one v that hangs on nothing: then v is the least of its component."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    left = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return left.agg(F.count("*")).first()[0] == 0


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with the least neighbour of u as m.

    The join has one more key than the grouping, so that both its sides are plain shuffles: Spark
    can then split a node that has very many edges over several tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.withColumn("h", F.xxhash64("u")).join(least.withColumn("h", F.xxhash64("u")), ["h", "u"]).drop("h")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Loops and edges with a null end count for nothing; repeated edges count once; without edges
    the result is empty. Each round shrinks the graph towards stars (Kiveris et al. 2014) and is
    written to the shared folder; a graph of stars needs none.
    """
    one = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = cut(one.distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = _with_least(large)
        hung = low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(now)
        now = new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of ``labels`` with further ``edges``, of which only the ends' labels are linked."""
    ends = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null")
    for end in ("_a", "_b"):
        of = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
        ends = ends.join(of, end, "left").withColumn(f"{end}_of", F.coalesce(f"{end}_of", end))
    merged = cut(components(cut(ends.select("_a_of", "_b_of").distinct()), "_a_of", "_b_of"))
    new = merged.select("node", F.col("node").alias("component")).join(labels.select("node"), "node", "left_anti")
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return labels.unionByName(new).join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
