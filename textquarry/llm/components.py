"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.tables import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's least node.

    Each round hangs nodes onto smaller ones, with one row per edge: a node of many edges is only
    ever grouped for its minimum or joined to it. The number of rounds is logarithmic.
    """

    def grown(now: DataFrame, least: DataFrame, on: str) -> DataFrame:
        return now.join(least.withColumnRenamed("node", on), on)

    def both_ways(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    def tidy(e: DataFrame) -> DataFrame:
        a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        return e.where("a <> b").select(a, b).distinct()

    now = scratch.write(tidy(edges), "edges")
    before, seen = None, mark(now)
    while seen != before:
        sides = both_ways(now)
        least = sides.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        large = tidy(grown(sides, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = scratch.write(large, "large")
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = grown(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        after = scratch.write(tidy(small), "small")
        scratch.drop(now)
        scratch.drop(large)
        now, before, seen = after, seen, mark(after)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return scratch.write(nodes.union(roots), "components")
