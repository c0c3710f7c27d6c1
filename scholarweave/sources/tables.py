"""The given tables, and the bibliographic roles they play in the catalogue.

paper = order (journal = nation of the customer, year = order year), author = supplier,
keyword = part name, citation = an order citing the customer's previous order.
Every view is a plain projection or join; nothing is collected or filtered away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TEXT_TABLES = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the scan has fewer splits than that.

    Text work is bound by CPU, and one small file is one split. A table of many files has
    more splits than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, year (int), journal, title."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("paper_id"),
            "year",
            F.col("n_name").alias("journal"),
            F.concat_ws(" ", F.lit("Study"), "c_mktsegment", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"),
        )
    )


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (paper_id, author_id) with the line the author first appears on."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"))
        .agg(F.min("l_linenumber").alias("line"))
    )


def paper_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (paper_id, keyword) with the line the keyword first appears on."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.col("p_name").alias("keyword"))
        .agg(F.min("l_linenumber").alias("line"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_type (the label as text), embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("node_type"), "embedding"
    )
