"""Connected components of an edge table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, component: the least node that links reach. Loops and repeats do no harm.

    Nodes without an edge to another, and edges with a null end, are not in the result; no edges give no rows. Extra
    columns of edges are not read.

    A large star links every greater neighbour of a node to the least of its neighbourhood, a small star every lesser
    one; the edges come to be stars around the least nodes in a number of rounds that grows with the logarithm of the
    graph's size. A node's neighbours are never gathered: least neighbours are aggregated and joined back.
    """
    falling = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # not null, as a <> b is not
    now = stored(falling.distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every greater end stands in one edge only, and is no lesser end: then the lesser ends are the components."""
    upper = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = upper.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count()
