"""Connected components by alternating large-star and small-star (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, partitions, release

FEWEST = 64  # edges of a node that counts as a hub, at least


def _size(edges: DataFrame) -> tuple[int, int]:
    """How many edges (u, v), u > v, there are, and how many nodes keep them from being stars around each
    component's least node: those with an edge to a lesser node and any other edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 0 AND n > 1"))).first())


def hub_size(rows: int, spark: SparkSession) -> int:
    """From how many of so many rows on a node is a hub: 2 * partitions nodes at most have as many."""
    return max(FEWEST, rows // (2 * partitions(spark)))


def with_least(rows: DataFrame, hub: int) -> DataFrame:
    """rows (u, v, others) with m, the least v of each u. Nodes of more than `hub` rows
    get m from a broadcast, which has as many rows as rows / hub at most; so their rows stay
    where they are, and no task of the window for all others has a node with more than `hub`.
    rows stand in the plan three times, so they had better be a table."""
    hubs = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where(F.col("n") > hub)
    hubs = F.broadcast(hubs.select("u", "m"))
    rest = rows.join(hubs, "u", "left_anti").withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(hubs, "u").unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge list; component is the least
    node reachable. Null ends and self-loops name no edge; repeated edges count once.

    Every step is a count per node (combined before its shuffle) and one window by
    node, which the rows of hubs are left out of (:func:`with_least`): nodes with more than a
    2 * partitions-th of the edges, so 4 * partitions of them at most. Nothing is collected but two
    counts, by which the last round ends that leaves stars only. Both steps of each round are
    written to the shared folder and their plans let go, so the driver holds one short plan at a time.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest(a, b), F.least(a, b)
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(start.select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    size, open_ = _size(e)
    while open_:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = hub_size(size, spark)
        large = with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(large, "large")
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = cut(with_least(large, hub).select(F.inline(pairs)).where("u <> v").distinct(), "edges")
        drop(e, large)
        e = new
        del both, large, new
        release(spark)
        size, open_ = _size(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
