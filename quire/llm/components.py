"""Connected components by alternating large-star and small-star rounds.

Every round is a partial aggregation and a join on the node, which Spark splits when a node is hot, and is
written to the shared folder; no node's links are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. Each node's neighbours are tied to the least of its neighbourhood."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the least node of its component."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Written(ordered, "links")
    seen = None
    while True:
        state = now.df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        mid = Written(_star(now.df, True), "links")
        now.drop()
        now = Written(_star(mid.df, False), "links")
        mid.drop()
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
