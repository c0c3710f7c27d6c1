"""All measures of one graph as one typed table, from one stored adjacency.

The edges are made simple and stored once; degrees, components and totals are read from that table. The result is long: a measure, for lists a rank and
a node, and a value, so that the analyses of several graphs can be united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.operators.components import component_sizes, connected_components
from scholarweave.operators.graph_stats import both_directions, canonical_edges
from scholarweave.operators.ranking import top_per_group
from scholarweave.session import durable

TOP = 10


def analyse(nodes: DataFrame, edges: DataFrame, top: int = TOP) -> DataFrame:
    """(measure, rank, id, value) of an undirected graph; ``nodes``: id, ``edges``: src, dst. Parallel edges count once, loops do not.

    Totals: num_nodes, num_edges, density, average_degree, max_degree, isolated_nodes, num_components, largest_component, largest_share,
    is_connected (0 or 1). Lists: top_degree, top_component. A graph without nodes has zeros and no lists.
    """
    pairs = durable(canonical_edges(edges))
    around = both_directions(pairs).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    degrees = durable(nodes.select("id").distinct().join(around, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")))
    sizes = durable(component_sizes(connected_components(degrees.select("id"), pairs)))
    n, m, largest = F.col("n").cast("double"), F.col("m").cast("double"), F.col("largest").cast("double")
    one = degrees.agg(
        F.count("*").alias("n"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).alias("m"), F.coalesce(F.max("degree"), F.lit(0)).alias("most"), F.count_if(F.col("degree") == 0).alias("alone")
    ).withColumns({"parts": sizes.select(F.count("*")).scalar(), "largest": sizes.select(F.coalesce(F.max("size"), F.lit(0))).scalar()})
    values = {
        "num_nodes": n, "num_edges": m, "density": F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0), "average_degree": F.when(n > 0, 2 * m / n).otherwise(0.0), "max_degree": F.col("most"),
        "isolated_nodes": F.col("alone"), "num_components": F.col("parts"), "largest_component": largest, "largest_share": F.when(n > 0, largest / n).otherwise(0.0),
        "is_connected": (F.col("parts") == 1).cast("int"),
    }
    totals = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items()])).alias("x"))
    totals = totals.select("x.measure", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("id"), "x.value")
    return totals.unionByName(_first(degrees, "top_degree", "id", "degree", top)).unionByName(_first(sizes, "top_component", "component", "size", top))


def _first(df: DataFrame, measure: str, name: str, value: str, top: int) -> DataFrame:
    ranked = top_per_group(df.withColumn("measure", F.lit(measure)), ["measure"], [F.desc(value), F.asc(name)], top)
    return ranked.select("measure", F.col("rank").cast("int").alias("rank"), F.col(name).cast("string").alias("id"), F.col(value).cast("double").alias("value"))


def united(graphs: dict[str, tuple[DataFrame, DataFrame]], top: int = TOP) -> DataFrame:
    """(graph, measure, rank, id, value) of several graphs."""
    out = None
    for name, (nodes, edges) in graphs.items():
        part = analyse(nodes, edges, top).select(F.lit(name).alias("graph"), "measure", "rank", "id", "value")
        out = part if out is None else out.unionByName(part)
    return out
