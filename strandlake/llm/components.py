"""Connected components by alternating large-star and small-star steps.

Every step keeps the components and only moves edges towards smaller ids, until each component is a star around its
smallest id. Each round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import scratch, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the larger (large) or the smaller (small) neighbours of each node to its smallest one."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    linked = both.join(least, "node")
    moved = linked.where(F.col("other") > F.col("node")).select("other", "least") if large else linked.select("other", "least").unionByName(least.select(F.col("node").alias("other"), "least"))
    return moved.where("other != least").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id of the component of every node that has an edge to another node.

    Edges may repeat, go either way or lead to their own node; null ends are left out. A node's neighbours are only ever
    aggregated or joined, never collected, so a node with very many edges is no single task's load.
    """
    path = scratch(edges.sparkSession, "components")
    e = edges.select(F.greatest(edges[a], edges[b]).alias("a"), F.least(edges[a], edges[b]).alias("b")).where(edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b])).distinct()
    e, before, k = written(e, f"{path}/0"), None, 0
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, k = state, k + 1
        e = written(_star(_star(e, large=True), large=False), f"{path}/{k}")
