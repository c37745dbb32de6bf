"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``: the least node reachable from each.

    Nodes without a link to another are left out. Each round ties every node and its
    neighbours to the least among them, until only stars are left; a round is one
    aggregation and one join, both on written tables, so that a hub with a large part
    of all links is split by the skew join.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(
            both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least"
        )
        tied = both.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = least.select("a", F.col("low").alias("b"))
        before, edges = edges, materialize(tied.union(own).where("a <> b").distinct(), "edges")
        release(before, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
