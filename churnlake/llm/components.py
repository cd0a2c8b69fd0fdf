"""Connected components of a link table by large-star / small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: every node points its larger (or smaller) neighbours at the least node it knows.

    The least neighbour is a grouped minimum (combined before the shuffle), joined
    back to the links, so a node with very many links is never gathered in one place:
    the join is an inner sort-merge join whose hot partitions Spark can split.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else \
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)`` with a > b; component = least node reached.

    Rounds are written to the shared folder, so the plan stays short and a lost
    executor re-reads files. A round that leaves the set of links as it was ends the loop:
    the links then are stars around the least node of each component.
    """
    links = materialize(links.distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = links.agg(mark).first()[0]
    while True:
        links = materialize(_star(_star(links, large=True), large=False), "links")
        after = links.agg(mark).first()[0]
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
