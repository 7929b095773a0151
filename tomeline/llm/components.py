"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a minimum per node
    (combined before the shuffle) and a join on the node. The minima are written first: as a table of
    its own, the small side is broadcast or, beyond that size, lets adaptive execution split a node
    with very many edges. The edge count never grows, and the rounds grow with the logarithm of the
    longest path.
    """
    # Each edge points from the larger to the smaller node.
    now = scratch.table(f"{name}-0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark, turn = _mark(now), 0
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(f"{name}-{turn}-low", both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.table(f"{name}-{turn}-large", large)
        least = scratch.table(f"{name}-{turn}-least", large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.table(f"{name}-{turn + 1}", small)
        scratch.drop(f"{name}-{turn}", f"{name}-{turn}-low", f"{name}-{turn}-large", f"{name}-{turn}-least")
        turn += 1
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    # A star forest: every node points to the smallest of its component, which itself points nowhere.
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
