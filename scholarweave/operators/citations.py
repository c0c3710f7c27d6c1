"""Citation graph: edges, summaries and lags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.operators.ranking import exact_quantiles


def citation_edges(citations: DataFrame, papers: DataFrame, min_similarity: float | None = None) -> DataFrame:
    """Directed edges: no self citation, both ends known, the last of equal pairs kept.

    ``citations`` has citing_id, cited_id, seq and any attributes; ``seq`` is the load
    order that decides which duplicate stays.
    """
    rows = citations.filter(F.col("citing_id") != F.col("cited_id"))
    if min_similarity is not None:
        rows = rows.filter(F.col("similarity") >= min_similarity)
    known = papers.select(F.col("paper_id"))
    rows = rows.join(known.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").join(
        known.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi"
    )
    attributes = [c for c in citations.columns if c not in ("citing_id", "cited_id", "seq")]
    last = F.max_by(F.struct(*attributes), F.col("seq")).alias("_last") if attributes else F.max("seq").alias("_last")
    kept = rows.groupBy("citing_id", "cited_id").agg(last)
    return kept.select("citing_id", "cited_id", *[F.col(f"_last.{a}").alias(a) for a in attributes])


def citation_degrees(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """In and out degree of every paper; both ends are counted in one aggregation."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("citing_id").alias("paper_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("cited_id").alias("paper_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    counted = ends.groupBy(F.col("e.paper_id").alias("paper_id")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")
    )
    return papers.select("paper_id").join(counted, "paper_id", "left").na.fill(0, ["in_degree", "out_degree"])


def citation_summary(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Totals over all papers; papers that cite nothing count as zero."""
    return citation_degrees(edges, papers).agg(
        F.sum("out_degree").alias("total_citations"),
        F.count_if(F.col("out_degree") > 0).alias("papers_with_citations"),
        F.avg("out_degree").alias("mean_citations"),
        F.max("out_degree").alias("max_citations"),
    )


def citation_years(edges: DataFrame, papers: DataFrame) -> DataFrame:
    citing = papers.select(F.col("paper_id").alias("citing_id"), F.col("year").alias("citing_year"))
    cited = papers.select(F.col("paper_id").alias("cited_id"), F.col("year").alias("cited_year"))
    return edges.select("citing_id", "cited_id").join(citing, "citing_id").join(cited, "cited_id")


def citations_by_year(edges: DataFrame, papers: DataFrame) -> DataFrame:
    return citation_years(edges, papers).groupBy(F.col("citing_year").alias("year")).agg(F.count("*").alias("citations"))


def citation_lag(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: mean and median years between a paper and an older one it cites."""
    lags = citation_years(edges, papers).filter(F.col("citing_year") > F.col("cited_year"))
    lags = lags.select((F.col("citing_year") - F.col("cited_year")).alias("lag"))
    median = exact_quantiles(lags, "lag", [0.5]).select(F.max("quantile")).scalar()
    return lags.agg(F.count("*").alias("lagged_citations"), F.avg("lag").alias("avg_lag")).withColumn("median_lag", median)
