"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: every node's larger (or own and smaller) neighbours are linked to its minimum."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.where("b < a")
    low = (both.groupBy("a").agg(F.min("b").alias("low"))
           .select("a", F.least("a", "low").alias("low")))
    if larger:
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return (both.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b"))).where("a <> b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node with an edge; the label is the smallest node reachable.

    Alternating large and small stars: the minimum of a neighbourhood is combined before the
    shuffle, each round's edges are written, and the number of rounds grows with the logarithm
    of the longest path. Self links and null ends are ignored; an empty table gives none.
    """
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or sums == last:
            break
        last = sums
        now = written(_stars(_stars(now, True).distinct(), False).distinct(), "edges")
    # at the end every edge joins a node to its component's minimum
    ends = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return ends.union(ends.select("label", "label")).distinct()
