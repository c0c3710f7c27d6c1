"""From a table of documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; all but the last return the columns of the documents.
A stage's result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarweave.llm import decontaminate, line_dedup, near_dedup, packing, quality_gam
from scholarweave.llm.common import masked, restored, table
from scholarweave.llm.queries import KEEP_FROM, quality_model
from scholarweave.session import scratch

SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    plain, back = masked(docs, "text")
    scored = quality_gam.score(plain, quality_model(spark, sf_dir))
    return restored(scored.filter(F.col("score") >= KEEP_FROM), back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines and the long lines that stand earlier; one of which nothing but blanks is left goes."""
    plain, back = masked(docs, "doc_id", "text")
    cut = line_dedup.remove_repeats(plain)
    emptied = (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) == "") & (F.col("n_removed") > 0)
    return restored(cut.filter(~F.coalesce(emptied, F.lit(False))), back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates."""
    return near_dedup.keep_one(docs, SHINGLE)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' words."""
    return packing.sequences(packing.word_counts(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", contamination),
    ("packing", pack),
]

# The classifier, the sketches and best-fit have no form in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
