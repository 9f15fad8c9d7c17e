"""Connected components by alternating large-star and small-star steps, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and its component's smallest node, for every node of ``links`` (a, b: long).

    A step is one minimum per node and one join back on the node. Minima combine before the shuffle, and the join is a
    plain equi-join, of which adaptive execution splits a hot node. Ends when a round changes no link.
    """
    now = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        # Large star: larger neighbours of a node link to the smallest of it and its neighbours.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = stored(large.where("a <> b"), "large")
        # Small star: a node and its smaller neighbours link to the smallest of these.
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = stored(small, "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
