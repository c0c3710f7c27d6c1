"""Readers for PDFs, graph files, question lists and stored embeddings."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarweave.functions.text import strip
from scholarweave.session import scratch
from scholarweave.sources.json_ranges import RANGE_BYTES, read_objects

try:
    import pypdf
except ImportError:  # the reader is optional
    pypdf = None


def pypdf_text(content: bytes, max_pages: int | None) -> str:
    pages = pypdf.PdfReader(io.BytesIO(content)).pages
    return "\n".join(p.extract_text() or "" for p in (pages[:max_pages] if max_pages else pages))


def read_pdf_texts(spark: SparkSession, path: str, max_pages: int | None = None, extract: Callable[[bytes, int | None], str] | None = None) -> DataFrame:
    """(pdf_file, text): text of all pages, or of the first ``max_pages``; empty when a file cannot be read.

    ``extract`` turns bytes into text and may be any PDF library; files are spread over
    the tasks and only their text leaves them.
    """
    if extract is None and pypdf is None:
        raise RuntimeError("no PDF library is installed: pass extract=")
    reader = extract or pypdf_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = []
            for content in part["content"]:
                try:
                    texts.append(reader(content, max_pages))
                except Exception:  # noqa: BLE001 - an unreadable file gives no text
                    texts.append("")
            yield pd.DataFrame({"pdf_file": part["path"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "pdf_file string, text string")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question per line; blank lines and lines starting with '#' are left out."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("question"))
    return rows.filter((F.col("question") != "") & ~F.col("question").startswith("#"))


def read_graph_json(
    spark: SparkSession, path: str, required: tuple[str, ...] = ("nodes", "edges"), range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file {"nodes": [...], "edges": [...]}, or of the folders that ``write_graph_json`` writes.

    A file is read in byte ranges by many tasks (``json_ranges``); its objects become JSON lines in the shared folder, from which
    attributes are inferred. An empty array gives an empty table. It fails if an array of ``required`` is missing.
    """
    if all(_exists(spark, f"{path}/{name}") for name in ("nodes", "edges")):
        tables = {name: spark.read.json(f"{path}/{name}") for name in ("nodes", "edges")}
    else:
        objects, arrays = read_objects(spark, path, range_bytes)
        missing = [c for c in required if c not in arrays]
        if missing:
            raise ValueError(f"{path} lacks {missing}")
        lines = scratch(spark, "graph")
        objects.filter(F.col("key").isin("nodes", "edges")).write.partitionBy("key").text(lines)
        tables = {name: spark.read.json(f"{lines}/key={name}") for name in ("nodes", "edges") if _exists(spark, f"{lines}/key={name}")}
    nodes = tables.get("nodes", spark.createDataFrame([], "id string"))
    edges = tables.get("edges", spark.createDataFrame([], "source string, target string"))
    return nodes, edges.withColumnsRenamed({"source": "src", "target": "dst"})


def read_graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_graphs(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict[str, tuple[DataFrame, DataFrame]], list[str]]:
    """The graphs that are there, and the names of those that are not."""
    found = {n: read_graph_tables(spark, f"{folder}/{n}") for n in names if _exists(spark, f"{folder}/{n}/nodes")}
    return found, [n for n in names if n not in found]


def read_embeddings(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """Stored vectors joined with their metadata by (node_type, node_id); missing metadata is the type alone."""
    vectors = spark.read.parquet(path)
    if metadata is None:
        return vectors
    joined = vectors.join(metadata.withColumn("_known", F.lit(True)), ["node_type", "node_id"], "left")
    return joined.withColumn("has_metadata", F.coalesce("_known", F.lit(False))).drop("_known")


def find_store(spark: SparkSession, folder: str, order: tuple[str, ...] = ("partitioned", "flat", "raw")) -> str:
    """First store layout that exists in the folder, in order of preference."""
    for kind in order:
        if _exists(spark, f"{folder}/{kind}"):
            return kind
    raise FileNotFoundError(f"no vector store in {folder}")


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds ``seq``, the load order of rows within their source, to decide duplicates."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return df.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")
