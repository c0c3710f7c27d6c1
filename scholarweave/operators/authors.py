"""Author collaboration graph and author-paper bipartite graph.

``authorship`` is the long table (paper_id, author_id, line); ``line`` orders the
authors of a paper. ``papers`` has paper_id, year, journal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.fixed_values import AI_DOMAIN, ENERGY_DOMAIN, ENGINEERING_DOMAIN
from scholarweave.operators.keywords import top_keywords_by
from scholarweave.operators.pairs import pair_counts, pairs_in_group
from scholarweave.operators.ranking import group_rank, top_per_group


def active_authors(authorship: DataFrame, min_papers: int) -> DataFrame:
    return authorship.groupBy("author_id").agg(F.count("*").alias("paper_count")).filter(F.col("paper_count") >= min_papers)


def collaboration_edges(authorship: DataFrame, min_collaborations: int = 1, min_papers: int = 1) -> DataFrame:
    """(author1, author2, collaboration_count) between active authors, author1 < author2."""
    rows = authorship
    if min_papers > 1:
        rows = rows.join(active_authors(authorship, min_papers).select("author_id"), "author_id", "left_semi")
    return (
        pair_counts(rows.select("paper_id", "author_id"), "paper_id", "author_id")
        .filter(F.col("weight") >= min_collaborations)
        .select(F.col("left").alias("author1"), F.col("right").alias("author2"), F.col("weight").alias("collaboration_count"))
    )


def common_papers(authorship: DataFrame, n: int = 5) -> DataFrame:
    """The first n shared papers of every collaborating pair, as an ordered array."""
    shared = pairs_in_group(authorship.select("paper_id", "author_id"), "paper_id", "author_id")
    first = top_per_group(shared, ["left", "right"], [F.asc("paper_id")], n)
    return first.groupBy(F.col("left").alias("author1"), F.col("right").alias("author2")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "paper_id"))), lambda s: s["paper_id"]).alias("common_papers")
    )


def with_author_flags(authorship: DataFrame) -> DataFrame:
    """Adds author_count, is_first, is_last and co_author_count without ordering any paper."""
    place = F.struct("line", "author_id")
    ends = authorship.groupBy("paper_id").agg(
        F.count("*").alias("author_count"), F.min(place).alias("_head"), F.max(place).alias("_tail")
    )
    return (
        authorship.join(ends, "paper_id")
        .withColumn("is_first", F.col("_head.author_id") == F.col("author_id"))
        .withColumn("is_last", F.col("_tail.author_id") == F.col("author_id"))
        .withColumn("co_author_count", F.col("author_count") - 1)
        .drop("_head", "_tail")
    )


def authored_edges(authorship: DataFrame) -> DataFrame:
    """Bipartite edges with the 0-based position of the author on the paper."""
    ranked = group_rank(authorship, ["paper_id"], ["line", "author_id"], "_rank", "_size")
    return ranked.select(
        "author_id",
        "paper_id",
        (F.col("_rank") - 1).alias("authorship_position"),
        (F.col("_rank") == 1).alias("is_first_author"),
        (F.col("_rank") == F.col("_size")).alias("is_last_author"),
        (F.col("_size") - 1).alias("co_author_count"),
    )


def productivity_class(paper_count: Column, active_years: Column, first_author_count: Column) -> Column:
    return (
        F.when((paper_count >= 10) & (active_years >= 5), "Highly Productive")
        .when((paper_count >= 5) & (first_author_count >= 2), "Leading Researcher")
        .when(paper_count >= 3, "Active Researcher")
        .when(paper_count == 1, "Newcomer")
        .otherwise("Occasional Contributor")
    )


def team_class(author_count: Column) -> Column:
    return (
        F.when(author_count == 1, "Single Author")
        .when(author_count <= 3, "Small Team")
        .when(author_count <= 6, "Medium Team")
        .otherwise("Large Team")
    )


def is_interdisciplinary(keywords: Column) -> Column:
    """At least three keywords that hit two of the three domain word sets exactly."""
    lowered = F.transform(keywords, F.lower)
    hits = [
        F.arrays_overlap(lowered, F.array(*[F.lit(w) for w in words])).cast("int")
        for words in (AI_DOMAIN, ENERGY_DOMAIN, ENGINEERING_DOMAIN)
    ]
    return (F.size(keywords) >= 3) & (sum(hits[1:], hits[0]) >= 2)


def _main_journal(dated: DataFrame, owner: str) -> DataFrame:
    """Most frequent journal per owner; the one seen on the earliest paper wins a tie."""
    counted = dated.groupBy(owner, "journal").agg(F.count("*").alias("_n"), F.min("paper_id").alias("_seen"))
    return counted.groupBy(owner).agg(
        F.count("*").alias("unique_journals"),
        F.max_by("journal", F.struct(F.col("_n"), -F.col("_seen"))).alias("most_frequent_journal"),
    )


def author_statistics(authorship: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers, distinct collaborators, activity span and journals of every author."""
    dated = authorship.join(papers.select("paper_id", "year", "journal"), "paper_id")
    span = dated.groupBy("author_id").agg(
        F.count("*").alias("paper_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    partners = (
        pair_counts(authorship.select("paper_id", "author_id"), "paper_id", "author_id")
        .select(F.explode(F.array("left", "right")).alias("author_id"))
        .groupBy("author_id")
        .agg(F.count("*").alias("collaborator_count"))
    )
    return (
        span.join(partners, "author_id", "left")
        .join(_main_journal(dated, "author_id"), "author_id", "left")
        .select(
            "author_id",
            "paper_count",
            F.coalesce("collaborator_count", F.lit(0)).alias("collaborator_count"),
            "first_year",
            "last_year",
            (F.col("last_year") - F.col("first_year") + 1).alias("active_years"),
            "unique_journals",
            "most_frequent_journal",
        )
    )


def author_profiles(authorship: DataFrame, papers: DataFrame) -> DataFrame:
    """First/last/single counts, span, papers per year, journals, team size and class."""
    flagged = with_author_flags(authorship).join(papers.select("paper_id", "year", "journal"), "paper_id")
    base = flagged.groupBy("author_id").agg(
        F.count("*").alias("paper_count"),
        F.count_if("is_first").alias("first_author_count"),
        F.count_if("is_last").alias("last_author_count"),
        F.count_if(F.col("co_author_count") == 0).alias("single_author_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.avg("co_author_count").alias("avg_co_authors"),
    )
    by_year = flagged.groupBy("author_id", "year").agg(F.count("*").alias("_n"))
    yearly = by_year.groupBy("author_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("year", "_n"))), lambda s: F.concat_ws(":", s["year"], s["_n"])), ";"
        ).alias("papers_by_year")
    )
    active = F.col("last_year") - F.col("first_year") + 1
    return (
        base.join(yearly, "author_id")
        .join(_main_journal(flagged, "author_id"), "author_id")
        .withColumn("active_years", active)
        .withColumn("productivity_type", productivity_class(F.col("paper_count"), active, F.col("first_author_count")))
    )


def author_keywords(authorship: DataFrame, keywords: DataFrame, n: int = 10) -> DataFrame:
    """Each author's n most frequent keywords over their papers."""
    rows = authorship.select("paper_id", "author_id").join(keywords.select("paper_id", "keyword"), "paper_id")
    return top_keywords_by(rows, "author_id", n)


def paper_statistics(authorship: DataFrame) -> DataFrame:
    """Team class and experience mix of every paper (1, up to 5, more papers per author)."""
    experience = authorship.groupBy("author_id").agg(F.count("*").alias("_papers"))
    rows = authorship.select("paper_id", "author_id").join(experience, "author_id")
    return (
        rows.groupBy("paper_id")
        .agg(
            F.count("*").alias("author_count"),
            F.count_if(F.col("_papers") == 1).alias("novice"),
            F.count_if((F.col("_papers") > 1) & (F.col("_papers") <= 5)).alias("intermediate"),
            F.count_if(F.col("_papers") > 5).alias("experienced"),
        )
        .withColumn("collaboration_type", team_class(F.col("author_count")))
        .withColumn("has_experienced_authors", F.col("experienced") > 0)
    )


def filter_by_activity(authorship: DataFrame, min_papers_per_author: int, min_authors_per_paper: int) -> DataFrame:
    """Rows of active authors on papers that still have enough of them, with the new team size."""
    kept = authorship.join(active_authors(authorship, min_papers_per_author).select("author_id"), "author_id", "left_semi")
    teams = kept.groupBy("paper_id").agg(F.count("*").alias("author_count")).filter(F.col("author_count") >= min_authors_per_paper)
    return kept.join(teams, "paper_id")


def team_types(authorship: DataFrame) -> DataFrame:
    sizes = authorship.groupBy("paper_id").agg(F.count("*").alias("author_count"))
    return sizes.groupBy(team_class(F.col("author_count")).alias("collaboration_type")).agg(F.count("*").alias("papers"))


def authorship_patterns(authorship: DataFrame) -> DataFrame:
    """One row: edges that are first, last and single authorships."""
    return with_author_flags(authorship).agg(
        F.count_if("is_first").alias("first_author_papers"),
        F.count_if("is_last").alias("last_author_papers"),
        F.count_if(F.col("co_author_count") == 0).alias("single_author_papers"),
    )


def productivity_types(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("productivity_type").agg(F.count("*").alias("authors"), F.sum("paper_count").alias("papers"))


def activity_by_year(authorship: DataFrame, papers: DataFrame) -> DataFrame:
    """Per year: authorship edges, distinct papers and distinct authors."""
    dated = authorship.join(papers.select("paper_id", "year"), "paper_id")
    edges = dated.groupBy("year", "paper_id").agg(F.count("*").alias("_n")).groupBy("year").agg(
        F.sum("_n").alias("authorships"), F.count("*").alias("papers")
    )
    people = dated.select("year", "author_id").distinct().groupBy("year").agg(F.count("*").alias("authors"))
    return edges.join(people, "year")
