"""Unordered pairs inside groups (keywords of a paper, authors of a paper)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.session import durable

# Largest number of members one join key may hold; a bigger group is cut into blocks.
BLOCK = 512
# Members whose pairs are laid out and counted by one task.
MEMBERS = 1 << 18


def _listed_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of groups that are small enough for one list each: one shuffle by group, and no join."""
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // MEMBERS))
    listed = members.repartition(tasks, group).groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("_items")).filter(F.size("_items") > 1)
    firsts = listed.select(group, "_items", F.posexplode("_items").alias("_at", "left"))
    return firsts.select(group, "left", F.explode(F.slice("_items", F.col("_at") + 2, F.size("_items"))).alias("right"))


def pairs_in_group(members: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """(group, left, right) with left < right, for distinct (group, item) rows; rows without a group or an item have no pairs.

    The members are stored once, and the groups of more than ``block`` members are counted. All other groups are
    listed in one row each, whose pairs are laid out where the row is. A larger group is hashed into blocks
    and joined block against block: no join key holds more than about two blocks, and one
    huge paper spreads over as many tasks as it has block pairs.
    """
    members = durable(members.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull()))
    large = durable(
        members.groupBy(group)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > block)
        .select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    )
    if large.isEmpty():
        return _listed_pairs(members, group, item)
    plain = _listed_pairs(members.join(large.select(group), group, "left_anti"), group, item)

    placed = (
        members.join(large, group)
        .withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(group, item, "_own", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))
    )
    same_cell = (
        (F.col(f"l.{group}") == F.col(f"r.{group}"))
        & (F.col("l._low") == F.col("r._low"))
        & (F.col("l._high") == F.col("r._high"))
        & (F.col(f"l.{item}") < F.col(f"r.{item}"))
        # two members of one block meet in that block's own cell only
        & ((F.col("l._own") != F.col("r._own")) | (F.col("l._low") == F.col("l._high")))
    )
    blocked = placed.alias("l").join(placed.alias("r"), same_cell)
    out = [F.col(f"l.{group}").alias(group), F.col(f"l.{item}").alias("left"), F.col(f"r.{item}").alias("right")]
    return plain.unionByName(blocked.select(*out))


def pair_counts(members: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """(left, right, weight): the number of groups in which both items occur."""
    return pairs_in_group(members, group, item, block).groupBy("left", "right").agg(F.count("*").alias("weight"))
