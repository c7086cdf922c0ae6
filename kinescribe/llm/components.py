"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import stage

#: A step at least halves the height of every tree, so this allows for more nodes than a long can number.
MAX_STEPS = 80


def _towards_smallest(links: DataFrame, smaller: bool) -> DataFrame:
    """Link the neighbours of every node ``u`` (those above it, or those not above it) to the smallest one around it."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(low, "u").withColumn("m", F.least("u", "m"))
    if smaller:
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); a component is named by its smallest node.

    Links with a null end and links of a node to itself say nothing. Every step works on one row per link,
    reads the written result of the step before, and is found to be the last when it changes no link.
    A node that has very many links meets them as one skewed join key, which adaptive execution splits.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stage(links)
    if links.isEmpty():
        return links.toDF("node", "component")
    before = None
    for _ in range(MAX_STEPS):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stage(_towards_smallest(both, False).where("a <> b").distinct())
        small = _towards_smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True).where("a <> b").distinct()
        links = stage(small)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    nodes = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    # Now every link leads straight to the smallest node of its component, which has no link of its own.
    return nodes.union(links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component")))
