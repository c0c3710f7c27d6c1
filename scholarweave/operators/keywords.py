"""Keyword graph: frequencies, filtering and co-occurrence.

Input is the long table (paper_id, keyword, line), one row per keyword of a paper, or
a papers table with a ``keywords`` array for the cleaning step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.functions.text import clean_keyword
from scholarweave.operators.pairs import pair_counts
from scholarweave.operators.ranking import top_per_group
from scholarweave.session import durable


def paper_keyword_table(papers: DataFrame, max_keywords: int | None = None) -> DataFrame:
    """Cleaned keywords per paper with counts before and after; papers without any are left out.

    ``max_keywords`` cuts each paper's list after so many; by default all stay.
    """
    cleaned = F.filter(F.transform("keywords", clean_keyword), lambda k: k.isNotNull())
    if max_keywords is not None:
        cleaned = F.slice(cleaned, 1, max_keywords)
    return (
        papers.withColumn("original_keyword_count", F.size("keywords"))
        .withColumn("keywords", cleaned)
        .withColumn("clean_keyword_count", F.size("keywords"))
        .filter(F.col("clean_keyword_count") > 0)
        .select("paper_id", "title", "keywords", "original_keyword_count", "clean_keyword_count")
    )


def explode_keywords(papers: DataFrame) -> DataFrame:
    """Distinct (paper_id, keyword, line) from a ``keywords`` array."""
    return (
        papers.select("paper_id", F.posexplode("keywords").alias("line", "keyword"))
        .groupBy("paper_id", "keyword")
        .agg(F.min("line").alias("line"))
    )


def keyword_frequency(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("keyword").agg(F.count("*").alias("freq"))


def top_keywords(keywords: DataFrame, n: int) -> DataFrame:
    """The n most frequent keywords; the first to appear wins a tie."""
    counted = keywords.groupBy("keyword").agg(F.count("*").alias("freq"), F.min(F.struct("paper_id", "line")).alias("_seen"))
    return counted.orderBy(F.desc("freq"), "_seen", "keyword").limit(n).select("keyword", "freq")


def frequent_keywords(keywords: DataFrame, min_freq: int | Column) -> DataFrame:
    """Keyword rows of papers, without keywords rarer than ``min_freq`` (a number or a scalar)."""
    keep = keyword_frequency(keywords).filter(F.col("freq") >= min_freq).select("keyword")
    return keywords.join(keep, "keyword", "left_semi")


def cooccurrence_edges(keywords: DataFrame, min_freq: int = 2, min_cooccurrence: int = 2) -> DataFrame:
    """(keyword1, keyword2, weight, jaccard_similarity, normalized_weight), keyword1 < keyword2."""
    keywords = durable(keywords.select("paper_id", "keyword"))  # read for the frequencies and for the pairs
    freq = durable(keyword_frequency(keywords).filter(F.col("freq") >= min_freq))
    kept = keywords.join(freq.select("keyword"), "keyword", "left_semi")
    counted = pair_counts(kept, "paper_id", "keyword").filter(F.col("weight") >= min_cooccurrence)
    f1 = freq.select(F.col("keyword").alias("left"), F.col("freq").alias("f1"))
    f2 = freq.select(F.col("keyword").alias("right"), F.col("freq").alias("f2"))
    together = F.col("weight").cast("double")
    return (
        counted.join(f1, "left")
        .join(f2, "right")
        .select(
            F.col("left").alias("keyword1"),
            F.col("right").alias("keyword2"),
            "weight",
            (together / (F.col("f1") + F.col("f2") - F.col("weight"))).alias("jaccard_similarity"),
            (together / F.greatest("f1", "f2")).alias("normalized_weight"),
        )
    )


def visual_subgraph(keywords: DataFrame, edges: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Top-n keywords with the edges among them and each one's degree centrality there."""
    nodes = top_keywords(keywords, n)
    kept = edges.join(nodes.select(F.col("keyword").alias("keyword1")), "keyword1", "left_semi").join(
        nodes.select(F.col("keyword").alias("keyword2")), "keyword2", "left_semi"
    )
    ends = kept.select(F.explode(F.array("keyword1", "keyword2")).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("degree"))
    others = nodes.select(F.count("*") - 1).scalar()
    scored = nodes.join(ends, "keyword", "left").select(
        "keyword",
        "freq",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.coalesce("degree", F.lit(0)) / others).alias("degree_centrality"),
    )
    return scored, kept


def top_keywords_by(rows: DataFrame, owner: str, n: int) -> DataFrame:
    """(owner, keyword, freq, rank): each owner's n most frequent keywords, ties alphabetically."""
    counted = rows.groupBy(owner, "keyword").agg(F.count("*").alias("freq"))
    return top_per_group(counted, [owner], [F.desc("freq"), F.asc("keyword")], n)
