"""Counts, density, degrees, clustering and attribute lookups for any graph.

``nodes`` has ``id``; ``edges`` has ``src`` and ``dst`` (for an undirected graph each
pair once, in either orientation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.operators.ranking import group_rank
from scholarweave.operators.triangles import count_triangles
from scholarweave.session import durable


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Simple undirected graph: no loops, one row per pair, src < dst."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """(node, neighbour), every edge seen from both ends."""
    pair = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour")),
    )
    return edges.select(F.inline(pair))


def density(nodes: DataFrame, edges: DataFrame, directed: bool) -> DataFrame:
    """One row: num_nodes, num_edges, density."""
    n = F.col("num_nodes").cast("double")
    possible = n * (n - 1) if directed else n * (n - 1) / 2
    edge_count = edges.select(F.count("*")).scalar()
    return (
        nodes.agg(F.count("*").alias("num_nodes"))
        .withColumn("num_edges", edge_count)
        .withColumn("density", F.when(n > 1, F.col("num_edges") / possible).otherwise(F.lit(0.0)))
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree and the three centralities; isolated nodes count as zero."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    others = nodes.select(F.count("*") - 1).scalar()
    filled = nodes.select("id").join(counted, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    filled = filled.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    for name in ("degree", "in_degree", "out_degree"):
        filled = filled.withColumn(f"{name}_centrality", F.when(others > 0, F.col(name) / others).otherwise(F.lit(0.0)))
    return filled


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over all nodes: mean, maximum and minimum degree, mean in and out degree."""
    return degrees(nodes, edges).agg(
        F.avg("degree").alias("avg_degree"),
        F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"),
        F.avg("in_degree").alias("avg_in_degree"),
        F.avg("out_degree").alias("avg_out_degree"),
    )


def top_by(df: DataFrame, score: str, n: int = 10, tie: str = "id") -> DataFrame:
    """The n highest rows; ties go to the smaller id."""
    return df.orderBy(F.desc(score), F.asc(tie)).limit(n)


def enrich_edges(edges: DataFrame, nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """Edge rows with both endpoints' attributes (``src_*`` and ``dst_*``)."""
    out = edges
    for side in ("src", "dst"):
        out = out.join(
            nodes.select(F.col("id").alias(side), *[F.col(a).alias(f"{side}_{a}") for a in attributes]), side, "left"
        )
    return out


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree, triangles and local clustering coefficient.

    Nodes are numbered by (degree, id), which points every edge from its lower end to the higher one: a hub has few
    successors, and ``count_triangles`` finds the common ones of both ends of an edge.
    """
    pairs = durable(canonical_edges(edges))
    deg = both_directions(pairs).groupBy("node").agg(F.count("*").alias("deg"))
    numbered = durable(group_rank(deg, [], ["deg", "node"], "r").select("node", "deg", "r"))
    counted = count_triangles(pairs, numbered)
    d = F.col("degree").cast("double")
    return (
        nodes.select("id")
        .join(numbered.select(F.col("node").alias("id"), F.col("deg").alias("degree")), "id", "left")
        .join(counted, "id", "left")
        .na.fill(0, ["degree", "triangles"])
        .withColumn("clustering", F.when(d > 1, 2 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0)))
    )


def clustering_summary(local: DataFrame) -> DataFrame:
    """One row: average clustering and transitivity."""
    d = F.col("degree").cast("double")
    return local.agg(
        F.avg("clustering").alias("average_clustering"),
        (F.sum("triangles") * 2 / F.sum(d * (d - 1))).alias("transitivity"),
    )
