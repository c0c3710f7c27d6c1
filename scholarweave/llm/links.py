"""Connected components of links between document ids.

Every round connects the neighbours of each node to the smallest of them, first those
above the node and then those below it, until the links no longer change; they are then
stars around the smallest id of each component. Rounds grow with the logarithm of the
longest chain. Each is made of aggregations that combine before the shuffle and joins that
adaptive execution splits, and ends in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import durable


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest id that each linked node reaches. ``links`` has columns a and b; self-links do not count."""
    ordered = links.filter("a is not null and b is not null and a <> b")
    links = durable(ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while True:
        # a is the larger end. Larger neighbours of a node meet the smallest one around it.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        up = links.select(F.col("a").alias("v"), F.col("b").alias("a")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        up = up.filter("a <> b").distinct()
        # Smaller neighbours of a node, and the node, meet the smallest of them.
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = durable(down.filter("a <> b").distinct())
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
