"""Ranks, running totals and quantiles that do not pull a group into one task.

A plain window over a key sorts the whole key in one task. That is fine for the
first few rows of a key (Spark cuts each map output to k rows before shuffling), but
not for a full ranking when one key may hold a third of the table. ``running_total``
and ``group_rank`` therefore lay the rows out by a range partitioning on
(key, order), so that a hot key spans many partitions, and carry one subtotal per
partition piece across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarweave.session import durable


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key with their 1-based rank.

    The filter on ``row_number`` lets Spark keep at most k rows per key before the
    shuffle, so the size of a key does not matter.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    total: str,
    grand_total: str | None = None,
    descending: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sum of ``weight`` per key in the given order.

    ``order`` must be unique within a key: it decides the layout as well as the sum.
    """
    keys = list(keys)
    ordering = [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]
    laid_out = durable(
        df.withColumn("_w", weight)
        .repartitionByRange(*[F.col(k) for k in keys], *ordering)
        .withColumn("_piece", F.spark_partition_id())
    )
    by_key = Window.partitionBy(*keys)
    subtotals = (
        laid_out.groupBy("_piece", *keys)
        .agg(F.sum("_w").alias("_sub"))
        .withColumn("_upto", F.sum("_sub").over(by_key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_carried", F.col("_upto") - F.col("_sub"))
        .withColumn("_all", F.sum("_sub").over(by_key))
        .select("_piece", *keys, "_carried", "_all")
    )
    within = Window.partitionBy("_piece", *keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    out = laid_out.join(subtotals, ["_piece", *keys]).withColumn(total, F.col("_carried") + F.sum("_w").over(within))
    if grand_total:
        out = out.withColumn(grand_total, F.col("_all"))
    return out.drop("_w", "_piece", "_carried", "_all")


def group_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: str = "rank",
    size: str | None = None,
    descending: Sequence[str] = (),
) -> DataFrame:
    """1-based position of every row within its key, and optionally the key's size."""
    return running_total(df, keys, order, F.lit(1).cast("long"), rank, size, descending)


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row (probability, quantile) each.

    Equal values are counted first, so the ordered pass sees each value once and a
    value shared by many rows costs nothing.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_total(counted, [], ["_v"], F.col("_n"), "_last", "_rows").withColumn("_first", F.col("_last") - F.col("_n"))
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    # Each value answers for the positions it covers: the lower and upper neighbour of
    # a quantile are found by the value rows themselves, no row is looked up.
    hits = (
        placed.withColumn("probability", F.explode(points))
        .withColumn("_pos", F.col("probability") * (F.col("_rows") - 1))
        .withColumn("_lo", F.floor("_pos"))
        .withColumn("_hi", F.ceil("_pos"))
        .withColumn("_is_lo", (F.col("_lo") >= F.col("_first")) & (F.col("_lo") < F.col("_last")))
        .withColumn("_is_hi", (F.col("_hi") >= F.col("_first")) & (F.col("_hi") < F.col("_last")))
        .filter("_is_lo OR _is_hi")
    )
    return (
        hits.groupBy("probability")
        .agg(
            F.max(F.when(F.col("_is_lo"), F.col("_v"))).alias("_vlo"),
            F.max(F.when(F.col("_is_hi"), F.col("_v"))).alias("_vhi"),
            F.max(F.col("_pos") - F.col("_lo")).alias("_frac"),
        )
        .select("probability", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("quantile"))
    )


def distribution(df: DataFrame, value: str, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """Long-form (metric, value): count, mean, population deviation, extremes, quantiles."""
    column = F.col(value).cast("double")
    base = df.agg(
        F.count(column).cast("double").alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    ).unpivot([], ["count", "mean", "std", "min", "max"], "metric", "value")
    labels = F.format_string("p%d", F.round(F.col("probability") * 100).cast("int"))
    quantiles = exact_quantiles(df, value, probabilities).select(labels.alias("metric"), F.col("quantile").alias("value"))
    return base.unionByName(quantiles)
