"""Greedy star clustering as a parallel computation.

Going through keys in order, each joins the earliest centre within reach or becomes one. The centres are the
lexicographically first maximal independent set of the neighbour graph: a key all of whose earlier neighbours are known
to be members is a centre, a key with a centre among its earlier neighbours is a member. Rounds settle many keys at
once. Neighbours are found through shared pieces (a key within k edits of another shares one of k + 1 pieces with it,
moved by at most k places), so no pair of keys without a common piece is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import scratch, written


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """Consecutive numbers from 0 in a total order, without moving all rows to one task: counts of range partitions come first.

    The ranges are written once, so both passes see the same ones.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, scratch(df.sparkSession, "numbered"))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__k", within).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__part", "__k", "__before")


def edit_neighbours(keys: DataFrame, most: int) -> DataFrame:
    """(a, b, ord_a, ord_b) of keys (key, ord) with ord_a < ord_b and at most ``most`` edits between them.

    Keys shorter than ``most`` + 1 characters share the empty piece.
    """
    parts = most + 1
    size = F.greatest(F.floor(F.length("key") / parts), F.lit(0)).cast("int")
    # a key's own pieces, and for each length and place of another key's piece what stands there in this one
    lengths = keys.select(F.length("key").alias("n")).distinct()
    own = keys.select("key", "ord", F.length("key").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("p")).select("key", "ord", "n", "p", F.substr("key", F.col("p") * size + 1, size).alias("piece"))
    shift = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")
    other = keys.crossJoin(F.broadcast(lengths)).where(F.abs(F.length("key") - F.col("n")) <= most)  # the few lengths that occur
    other = other.select("key", "ord", "n", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("p")).select("key", "ord", "n", "p", shift)
    width = F.greatest(F.floor(F.col("n") / parts), F.lit(0)).cast("int")
    at = F.col("p") * width + 1 + F.col("shift")
    other = other.where((at >= 1) & (at + width - 1 <= F.length("key"))).select(F.col("key").alias("b"), F.col("ord").alias("ord_b"), "n", "p", F.substr("key", at, width).alias("piece")).distinct()
    met = own.select(F.col("key").alias("a"), F.col("ord").alias("ord_a"), "n", "p", "piece").join(other, ["n", "p", "piece"]).where("a != b")
    near = met.where(F.levenshtein("a", "b", most) >= 0).select("a", "b", "ord_a", "ord_b").distinct()
    first = F.col("ord_a") < F.col("ord_b")
    return near.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.least("ord_a", "ord_b").alias("ord_a"), F.greatest("ord_a", "ord_b").alias("ord_b")).distinct()


def first_centres(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, ord, centre, centre_ord) by greedy star clustering of ``keys`` (key, ord) with ``edges`` (a, b, ord_a, ord_b).

    Each round ends in a table, so its plan doesn't grow. A chain of n neighbours needs about n / 2 rounds.
    """
    folder, k = scratch(keys.sparkSession, "rounds"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal k
        k += 1
        return written(df, f"{folder}/{k}")

    edges = kept(edges)
    waiting = kept(keys.select("key", "ord"))
    centres = waiting.select("key").limit(0)
    while not waiting.isEmpty():
        # edges between keys that are not settled yet, and those from known centres
        earlier = edges.join(waiting.select(F.col("key").alias("b")), "b", "left_semi")
        held = earlier.join(waiting.select(F.col("key").alias("a")), "a", "left_semi").select(F.col("b").alias("key")).distinct()
        new = waiting.join(held, "key", "left_anti")
        centres = kept(centres.unionByName(new.select("key")))
        covered = earlier.join(centres.select(F.col("key").alias("a")), "a", "left_semi").select(F.col("b").alias("key")).distinct()
        waiting = kept(waiting.join(centres, "key", "left_anti").join(covered, "key", "left_anti"))
    joined = edges.join(centres.select(F.col("key").alias("a")), "a", "left_semi").groupBy("b").agg(F.min(F.struct("ord_a", "a")).alias("c"))
    own = keys.select("key", "ord").join(joined.select(F.col("b").alias("key"), "c"), "key", "left")
    return own.select("key", "ord", F.coalesce("c.a", "key").alias("centre"), F.coalesce("c.ord_a", "ord").alias("centre_ord"))


def star_clusters(keys: DataFrame, most: int, also: Column | None = None) -> DataFrame:
    """Greedy star clustering of distinct ``keys`` (key, ord) within ``most`` edits, of pairs (a, b) for which ``also`` holds."""
    edges = edit_neighbours(keys, most)
    return first_centres(keys, edges if also is None else edges.where(also))


def near_neighbours(points: DataFrame, coordinates: list[str], within: int) -> DataFrame:
    """Edges of ``points`` (key, ord, coordinates) that differ by less than ``within`` in each coordinate, by grid cells."""
    cell = lambda df, spread: df.select("*", *(F.floor(F.col(c) / within).alias(f"__{c}") for c in coordinates)) if not spread else df
    left = cell(points, False)
    right = points
    for c in coordinates:
        right = right.withColumn(f"__{c}", F.explode(F.array(*((F.floor(F.col(c) / within) + d) for d in (-1, 0, 1)))))
    right = right.select(F.col("key").alias("b"), F.col("ord").alias("ord_b"), *(F.col(c).alias(f"b_{c}") for c in coordinates), *(f"__{c}" for c in coordinates))
    close: Column = F.col("ord") < F.col("ord_b")
    for c in coordinates:
        close &= F.abs(F.col(c) - F.col(f"b_{c}")) < within
    return left.join(right, [f"__{c}" for c in coordinates]).where(close).select(F.col("key").alias("a"), "b", F.col("ord").alias("ord_a"), "ord_b").distinct()


def position_clusters(pairs: DataFrame, within: int = 50, k: int = 50) -> DataFrame:
    """(start, end, count) clustered by place, most frequent first: the k clusters with the most reads."""
    points = numbered(pairs, F.desc("count"), "start", "end", name="ord").withColumn("key", F.concat_ws("-", "start", "end"))
    merged = first_centres(points, near_neighbours(points, ["start", "end"], within)).join(points.select("key", "count"), "key")
    return merged.groupBy("centre").agg(F.sum("count").alias("count"), F.count("*").alias("members")).orderBy(F.desc("count"), "centre").limit(k)

