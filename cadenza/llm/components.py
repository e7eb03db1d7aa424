"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges(a, b) that links to another.

    Each step only groups by node with a partial minimum, so a node with very many links is combined
    before it is shuffled; tables in the shared folder cut the lineage. Empty edges give no rows;
    loops and repeated edges change nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, "cc")
    before = _sum(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node move to its smallest neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        e = stored(small, "cc")
        now = _sum(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _sum(edges: DataFrame) -> tuple:
    """How many edges, and two sums over them; equal ones are the same edges but for a chance of 2 ** -100 or so."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), wide(1), wide(2)).first())
