"""Connected components of an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for each node of ``edges`` (a, b longs); ``component`` is the smallest node reached.

    Each round every node is merged into the smallest of itself and its neighbours, and the edges
    between what was merged are kept, once each. Stars end in one round; a path halves at least. Loops
    and repeated edges do no harm; no edges give no rows. Nothing but counts reaches the driver.
    """
    from .minhash import _by_key

    spark = edges.sparkSession
    left = scratch.keep(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = spark.createDataFrame([], "node long, component long")
    first = True
    while n := left.count():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("c"))
        step = scratch.keep(smaller.select("node", F.least("node", "least").alias("into"), "c"), "step")
        if first:
            found = scratch.keep(step.select("node", F.col("into").alias("component")), "found")
        else:  # a component may have many nodes
            sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
            facts = sizes.join(step.select(F.col("node").alias("component"), "into"), "component")
            moved = _by_key(found, scratch.keep(facts, "moves"), "component", scratch, found.count(), "left")
            found = scratch.keep(moved.select("node", F.coalesce("into", "component").alias("component")), "found")
        for c in "ab":  # a node may have many edges
            ends = step.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"), "c")
            left = _by_key(left, ends, c, scratch, n)
        merged = left.select(F.least("a_into", "b_into").alias("a"), F.greatest("a_into", "b_into").alias("b"))
        left, first = scratch.keep(merged.filter("a != b").distinct(), "edges"), False
    return found
