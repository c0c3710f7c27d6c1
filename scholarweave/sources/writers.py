"""Writers: tables, CSV for people, graph files and vector stores. Every file is written by the tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarweave.functions.text import xml_safe
from scholarweave.operators.graph_stats import enrich_edges


def flat(df: DataFrame, separator: str = "; ") -> DataFrame:
    """Lists joined into text and nested values as JSON, for formats without nesting."""

    def one(field: T.StructField) -> Column:
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.array_join(F.col(field.name).cast("array<string>"), separator).alias(field.name)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name)

    return df.select(*[one(f) for f in df.schema.fields])


def write_metadata(papers: DataFrame, path: str) -> None:
    """JSON lines or CSV, by the ending of the path."""
    if path.endswith(".csv"):
        flat(papers).write.mode("overwrite").option("header", "true").csv(path)
    else:
        papers.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, encodings: tuple[str, ...] = ("UTF-8",)) -> None:
    """One copy per encoding."""
    for encoding in encodings:
        flat(df).write.mode("overwrite").option("header", "true").option("encoding", encoding).csv(f"{path}/{encoding.lower()}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, attributes: list[str] | None = None) -> None:
    """Nodes and edges as tables partitioned by type, and the edge list with endpoint attributes as CSV."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
    if attributes:
        flat(enrich_edges(edges, nodes, attributes)).write.mode("overwrite").option("header", "true").csv(f"{path}/edge_list")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{path}/edges")


def graphml_lines(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(part, id, line): the lines of a GraphML document; sorted by (part, id) they are the document."""

    def data(df: DataFrame, skip: tuple[str, ...]) -> Column:
        shown = flat(df)
        parts = [
            F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), xml_safe(F.col(c).cast("string")), F.lit("</data>")))
            for c in shown.columns if c not in skip
        ]
        return F.concat_ws("", *parts)

    spark = nodes.sparkSession
    keys = [(1, f"{where}{c}", f'<key id="{c}" for="{where}" attr.name="{c}" attr.type="string"/>')
            for where, df, skip in (("node", nodes, ("id",)), ("edge", edges, ("src", "dst"))) for c in df.columns if c not in skip]
    frame = [(0, "", '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), *keys,
             (2, "", f'<graph edgedefault="{"directed" if directed else "undirected"}">'), (5, "", "</graph></graphml>")]
    fixed = spark.createDataFrame(frame, "part int, id string, line string")
    node_id = xml_safe(F.col("id").cast("string"))
    node_rows = flat(nodes).select(F.lit(3).alias("part"), F.col("id").cast("string").alias("id"), F.concat(F.lit('<node id="'), node_id, F.lit('">'), data(nodes, ("id",)), F.lit("</node>")).alias("line"))
    src, dst = xml_safe(F.col("src").cast("string")), xml_safe(F.col("dst").cast("string"))
    edge_rows = flat(edges).select(
        F.lit(4).alias("part"), F.concat_ws("\t", "src", "dst").alias("id"),
        F.concat(F.lit('<edge source="'), src, F.lit('" target="'), dst, F.lit('">'), data(edges, ("src", "dst")), F.lit("</edge>")).alias("line"),
    )
    return fixed.unionByName(node_rows).unionByName(edge_rows)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = True) -> None:
    """Text parts that make one GraphML document when joined in name order (a range sort, no single writer)."""
    graphml_lines(nodes, edges, directed).orderBy("part", "id").select("line").write.mode("overwrite").text(path)


def write_citations(citations: DataFrame, path: str) -> None:
    """The citation table in three shapes: detailed, as graph edges, and as lists per paper."""
    cut = F.when(F.length("reference_text") > 200, F.concat(F.substring("reference_text", 1, 200), F.lit("..."))).otherwise(F.col("reference_text"))
    citations.withColumn("reference_text", cut).write.mode("overwrite").json(f"{path}/detailed")
    citations.select(F.col("citing_id").alias("source"), F.col("cited_id").alias("target"), F.col("similarity").alias("weight")).write.mode("overwrite").parquet(f"{path}/edges")
    citations.select("citing_id", "cited_id").write.mode("overwrite").json(f"{path}/simple")


def write_store(embeddings: DataFrame, path: str, kind: str = "partitioned") -> None:
    """A vector store: partitioned by node type, or flat. Converting is reading one and writing the other."""
    writer = embeddings.write.mode("overwrite")
    (writer.partitionBy("node_type") if kind == "partitioned" else writer).parquet(f"{path}/{kind}")


def cache_path(folder: str, settings: dict) -> str:
    """Folder of a cached result, named after the settings that produced it."""
    return f"{folder}/{hashlib.md5(json.dumps(settings, sort_keys=True).encode()).hexdigest()}"


def modified_at(spark: SparkSession, path: str) -> float:
    """Seconds at which the newest file of a path was written; 0 if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0.0
    newest, listed = 0, files.listFiles(root, True)
    while listed.hasNext():
        newest = max(newest, listed.next().getModificationTime())
    return newest / 1000


def cached(spark: SparkSession, folder: str, settings: dict, source: str, make: Callable[[], DataFrame], tolerance: float = 1.0) -> DataFrame:
    """The result of ``make``, stored under its settings and taken from there while the source is as old as it was then.

    ``source`` is the path the result is made from; within ``tolerance`` seconds its time counts as the same. The time is part of
    the stored result's name and a result without its ``_SUCCESS`` mark is made anew.
    """
    path, now = cache_path(folder, settings), modified_at(spark, source)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(root) if files.exists(root) else []:
        kept, _, at = found.getPath().getName().partition("=")
        if kept == "at_ms" and abs(int(at) / 1000 - now) < tolerance and files.exists(spark._jvm.org.apache.hadoop.fs.Path(found.getPath(), "_SUCCESS")):
            return spark.read.parquet(found.getPath().toString())
    fresh = f"{path}/at_ms={int(now * 1000)}"
    make().write.mode("overwrite").parquet(fresh)
    return spark.read.parquet(fresh)
