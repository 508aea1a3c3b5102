"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.plans.lineage import cut
from quarrylog.plans.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One step: each node hands its least neighbour to its neighbours (the greater ones, or all lesser ones and itself).

    The join's key is a struct, so that the minima's own partitioning does not serve it: both sides are plain exchanges, and
    a hub with very many edges is split by the adaptive skew join instead of landing in one task.
    """
    seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.struct("a").alias("k"), F.least("a", "m").alias("m"))
    greater = seen.where("b > a") if both_ways else edges
    out = greater.withColumn("k", F.struct("a")).join(least, "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not both_ways:
        out = out.union(least.select("k.a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges`` (its first two columns, one orderable type); component: the least node reachable.

    Self-loops and rows with a null are ignored, repeated and reversed edges count once, an empty table gives an empty
    one. Rounds grow with the logarithm of the longest path; nothing but a count and a checksum reaches the driver.

    Each step is a table of files, removed once the next is written: a checkpoint would keep the size that Spark estimates, and joined with itself
    round by round that number's digits double, until planning takes all of the driver's time and memory. The result is written, too.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    steps = Scratch(edges.sparkSession)
    edges = steps.put(edges)
    before = _mark(edges)
    for _ in range(max_rounds if before[0] else 0):
        large = steps.put(_star(edges, True))
        small = steps.put(_star(large, False))
        steps.drop(edges, large)
        edges = small
        if (after := _mark(edges)) == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct()))
    steps.drop()
    return found
