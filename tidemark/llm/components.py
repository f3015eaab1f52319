"""Connected components of a table of links, by joins and map-side minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (node, component), where the component is its smallest node.

    Each round points a node's larger neighbours, then its smaller ones, to the smallest node it
    sees. The links become stars around the smallest nodes in a number of rounds that grows with the
    logarithm of the longest path. Each round is a written table; the driver sees two sums of it.
    """
    links = links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a != b").distinct()
    links, before = stored(links, "links"), None
    while True:
        links = stored(_star(_star(links, large=True), large=False), "links")
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.selectExpr("a AS node", "b AS component").unionByName(roots)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b. Large: neighbours above a node go to its smallest neighbour or
    itself; small: neighbours below a node, and the node, go to the smallest of them."""
    if large:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", "m"))
    return moved.distinct()
