"""One typed multigraph out of six graphs: standardise, merge, connect across, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarweave.fixed_values import (
    BATTERY_TERMS,
    DEFAULT_EDGE_TYPES,
    EDGE_TYPE_ALIASES,
    EXPERIENCE_MARKS,
    ML_TERMS,
    SOURCE_GRAPHS,
)
from scholarweave.functions.text import strip, terms_found, terms_in, words
from scholarweave.operators.ranking import group_rank, top_per_group
from scholarweave.session import durable

NODE_COLUMNS = {
    "id": "string", "node_type": "string", "title": "string", "abstract": "string", "keywords": "array<string>",
    "authors": "array<string>", "year": "int", "journal": "string", "name": "string", "paper_count": "bigint",
    "collaborator_count": "bigint", "first_author_count": "bigint", "frequency": "bigint",
}
EDGE_COLUMNS = {"src": "string", "dst": "string", "edge_type": "string", "weight": "double"}


def _shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def inferred_type(node_id: Column, source: str) -> Column:
    """Kind of a node without one, from its id and the graph it came from."""
    lowered, out = F.lower(node_id), None
    for kind in ("paper", "author", "keyword", "journal"):
        hit = F.lit(True) if kind in source else lowered.contains(kind)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def abstract_quality(length: Column) -> Column:
    return F.when(length > 100, "good").when(length > 50, "fair").when(length > 0, "poor").otherwise("none")


def longest(*columns: Column) -> Column:
    """The longest of several texts, the first of equal ones; empty if there is none."""
    trimmed = [strip(F.coalesce(c, F.lit(""))) for c in columns]
    best = trimmed[0]
    for other in trimmed[1:]:
        best = F.when(F.length(other) > F.length(best), other).otherwise(best)
    return best


def unified_team(author_count: Column) -> Column:
    return F.when(author_count == 1, "Single Author").when(author_count <= 3, "Small Team").otherwise("Large Team")


def standardize_nodes(nodes: DataFrame, source: str) -> DataFrame:
    """Common columns, typed defaults and derived paper fields of one source graph."""
    alternatives = [F.col(c) for c in ("abstract", "description", "summary", "content") if c in nodes.columns]
    shaped = nodes.withColumn("abstract", longest(*alternatives)) if alternatives else nodes
    shaped = _shaped(shaped, NODE_COLUMNS)
    kind = F.coalesce("node_type", inferred_type(F.col("id"), source))
    none = F.array().cast("array<string>")
    tidy = F.filter(F.transform(F.coalesce("keywords", none), strip), lambda k: k != "")
    shaped = shaped.withColumns(
        {
            "node_type": kind,
            "source": F.lit(source),
            "rank": F.lit(SOURCE_GRAPHS.index(source)),
            "title": F.coalesce("title", F.lit("")),
            "abstract": F.coalesce("abstract", F.lit("")),
            "keywords": tidy,
            "authors": F.coalesce("authors", none),
            "year": F.when(F.col("year").between(1900, 2030), F.col("year")),
            "name": F.coalesce("name", F.when(kind != "paper", F.col("id"))),
            "paper_count": F.when(kind.isin("author", "journal"), F.coalesce("paper_count", F.lit(0))),
            "collaborator_count": F.when(kind == "author", F.coalesce("collaborator_count", F.lit(0))),
            "frequency": F.when(kind == "keyword", F.coalesce("frequency", F.lit(1))),
        }
    )
    # lower-case text is a column of its own, computed once for all terms
    scored = shaped.withColumn("_text", F.concat_ws("\n", F.lower("title"), F.lower("abstract")))
    scored = scored.withColumns(
        {
            "ml_relevance_score": F.size(terms_in(F.col("_text"), ML_TERMS)),
            "battery_relevance_score": F.size(terms_in(F.col("_text"), BATTERY_TERMS)),
            "has_experienced_authors": F.size(terms_found(F.array_join("authors", " "), EXPERIENCE_MARKS)) > 0,
        }
    ).drop("_text")
    return scored.withColumn("is_interdisciplinary", (F.col("ml_relevance_score") > 0) & (F.col("battery_relevance_score") > 0))


def merge_nodes(standardized: DataFrame) -> DataFrame:
    """One row per id. The longer text or list wins and the earlier graph an equal one, counts
    take their maximum, flags are or-ed, keyword frequencies add up, the rest comes from
    the first graph that had it. All of it is one aggregation with map-side combining.
    """
    rank = F.col("rank")
    pick_longest = lambda c, size: F.max_by(c, F.struct(size(c), -rank)).alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    keyword_chars = lambda c: F.length(F.array_join(c, "; "))
    most = F.max_by("paper_count", F.col("paper_count"))
    merged = standardized.groupBy("id").agg(
        F.min_by("node_type", rank).alias("node_type"),
        F.array_sort(F.collect_set("source")).alias("source_graphs"),
        pick_longest("title", F.length),
        pick_longest("abstract", F.length),
        F.max(F.length("abstract")).alias("abstract_length"),  # the chosen one's: without it no text has to travel
        pick_longest("keywords", keyword_chars),
        pick_longest("authors", F.size),
        F.min_by("year", rank).alias("year"),
        first("journal"),
        first("name"),
        most.alias("_most_papers"),
        F.min_by("paper_count", F.when(F.col("paper_count").isNotNull(), rank)).alias("_first_papers"),
        F.max("collaborator_count").alias("collaborator_count"),
        F.max("first_author_count").alias("first_author_count"),
        F.sum("frequency").alias("frequency"),
        F.max("ml_relevance_score").alias("ml_relevance_score"),
        F.max("battery_relevance_score").alias("battery_relevance_score"),
        F.bool_or("is_interdisciplinary").alias("is_interdisciplinary"),
        F.bool_or("has_experienced_authors").alias("has_experienced_authors"),
    )
    return merged.withColumns(
        {
            "paper_count": F.when(F.col("node_type") == "author", F.col("_most_papers")).otherwise(F.col("_first_papers")),
            "abstract_word_count": F.size(words(F.col("abstract"))),
            "abstract_quality": abstract_quality(F.col("abstract_length")),
            "has_abstract": F.col("abstract_length") > 0,
            "keyword_count": F.size("keywords"),
            "author_count": F.size("authors"),
            "collaboration_type": unified_team(F.size("authors")),
        }
    ).drop("_most_papers", "_first_papers")


def canonical_edge_type(edge_type: Column) -> Column:
    out = None
    for name, canonical in EDGE_TYPE_ALIASES.items():
        out = F.when(edge_type == name, canonical) if out is None else out.when(edge_type == name, canonical)
    return out.otherwise(edge_type)


def standardize_edges(edges: DataFrame, source: str) -> DataFrame:
    """Typed edges of one graph with a weight on the 0..1 scale and their key in the multigraph."""
    w = F.col("weight")
    return (
        _shaped(edges, EDGE_COLUMNS)
        .withColumn("edge_type", canonical_edge_type(F.coalesce("edge_type", F.lit(DEFAULT_EDGE_TYPES.get(source, "related_to")))))
        .withColumn("source_graph", F.lit(source))
        .withColumn("normalized_weight", F.when(w.isNull(), 1.0).when(w > 1, F.least(F.lit(1.0), w / 100.0)).otherwise(w))
        .withColumn("edge_key", F.concat_ws("_", "source_graph", "edge_type"))
    )


def unite(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _paper_keywords(nodes: DataFrame) -> DataFrame:
    papers = nodes.filter(F.col("node_type") == "paper")
    return papers.select(F.col("id").alias("paper"), F.explode("keywords").alias("k")).select("paper", strip(F.lower("k")).alias("word")).filter("word <> ''")


def _keyword_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type") == "keyword").select(F.col("id").alias("keyword"), F.lower("id").alias("word"))


# Ranks whose papers are linked in one window.
STRETCH = 4096


def _new_only(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    return candidates.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def _cross(rows: DataFrame, edge_type: str, weight: Column) -> DataFrame:
    return (
        rows.select("src", "dst", F.lit(edge_type).alias("edge_type"), weight.cast("double").alias("weight"))
        .withColumn("source_graph", F.lit("cross_connection"))
        .withColumn("normalized_weight", F.col("weight"))
        .withColumn("edge_key", F.concat_ws("_", "source_graph", "edge_type"))
    )


def connect_papers_to_keywords(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paper to the keyword node of the same lower-case name, where no edge exists yet."""
    one = _keyword_nodes(nodes).groupBy("word").agg(F.min("keyword").alias("dst"))
    pairs = _paper_keywords(nodes).join(one, "word").select(F.col("paper").alias("src"), "dst").distinct()
    return _cross(_new_only(pairs, edges), "has_keyword", F.lit(1.0))


def _owner_words(edges: DataFrame, nodes: DataFrame, edge_type: str, owner_kind: str) -> DataFrame:
    """(owner, word, freq) over the papers linked to each owner, whichever way the edge points."""
    kinds = nodes.select("id", "node_type")
    linked = edges.filter(F.col("edge_type") == edge_type).select("src", "dst")
    owners = kinds.filter(F.col("node_type") == owner_kind).select(F.col("id").alias("owner"))
    forward = linked.select(F.col("src").alias("owner"), F.col("dst").alias("paper"))
    backward = linked.select(F.col("dst").alias("owner"), F.col("src").alias("paper"))
    pairs = forward.unionByName(backward).join(owners, "owner", "left_semi").distinct()
    return pairs.join(_paper_keywords(nodes), "paper").groupBy("owner", "word").agg(F.count("*").alias("freq"))


def connect_authors_to_keywords(nodes: DataFrame, edges: DataFrame, min_freq: int = 2) -> DataFrame:
    counted = _owner_words(edges, nodes, "authored_by", "author").filter(F.col("freq") >= min_freq)
    pairs = counted.join(_keyword_nodes(nodes), "word").select(F.col("owner").alias("src"), F.col("keyword").alias("dst"), "freq")
    return _cross(_new_only(pairs, edges), "specializes_in", F.least(F.lit(1.0), F.col("freq") / 10.0))


def connect_journals_to_keywords(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each journal's top fifth of keywords (at least five), weighted by its most frequent one."""
    counted = _owner_words(edges, nodes, "published_in", "journal")
    ranked = group_rank(counted, ["owner"], ["freq", "word"], "_r", "_n", descending=["freq"])
    top = counted.groupBy("owner").agg(F.max("freq").alias("_top"))
    kept = ranked.filter(F.col("_r") <= F.greatest(F.lit(5), F.floor(F.col("_n") / 5))).join(top, "owner")
    pairs = kept.join(_keyword_nodes(nodes), "word").select(F.col("owner").alias("src"), F.col("keyword").alias("dst"), "freq", "_top")
    return _cross(_new_only(pairs, edges), "focuses_on", F.col("freq") / F.col("_top"))


def connect_years(nodes: DataFrame, edges: DataFrame, starts: int | None = None, reach: int = 10) -> DataFrame:
    """Weak links among the papers of a year in the order of their ids: each to the ``reach`` that follow it.

    ``starts`` keeps only the first so many papers of each year as sources; by default all are.
    """
    dated = nodes.filter((F.col("node_type") == "paper") & F.col("year").isNotNull()).select("id", "year")
    ranked = durable(group_rank(dated, ["year"], ["id"], "r"))
    # a stretch of ranks also has the first papers of the next one, so a list is read off inside its stretch
    stretch = lambda r: F.floor((r - 1) / max(STRETCH, reach))
    laid = ranked.select("id", "year", "r", F.explode(F.array_distinct(F.array(stretch(F.col("r")), F.greatest(F.lit(0), stretch(F.col("r") - reach))))).alias("_s"))
    ahead = Window.partitionBy("year", "_s").orderBy("r").rowsBetween(1, reach)
    listed = laid.withColumn("_next", F.collect_list(F.struct(F.col("id").alias("dst"), F.col("r").alias("_r"))).over(ahead)).filter(stretch(F.col("r")) == F.col("_s"))
    if starts is not None:
        listed = listed.filter(F.col("r") <= starts)
    # only edges between papers in reach of each other can be in the way, a few for each paper
    place = lambda side: ranked.select(F.col("id").alias(side), F.struct("year", "r").alias(f"_{side}"))
    taken = edges.select("src", "dst").join(place("src"), "src").join(place("dst"), "dst")
    taken = taken.filter((F.col("_src.year") == F.col("_dst.year")) & (F.col("_dst.r") - F.col("_src.r")).between(1, reach))
    taken = taken.groupBy(F.col("src").alias("id")).agg(F.collect_set("_dst.r").alias("_taken"))
    pairs = listed.join(taken, "id", "left").select(F.col("id").alias("src"), "_taken", F.inline("_next"))
    pairs = pairs.filter(F.col("_taken").isNull() | ~F.array_contains("_taken", F.col("_r"))).select("src", "dst")
    return _cross(pairs, "temporal_proximity", F.lit(0.1))


def add_cross_edges(nodes: DataFrame, edges: DataFrame, sources: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``edges`` and those of the four connectors. ``sources`` names the source graphs that a kind of new edges follows or could repeat; by default all."""
    connectors = {"has_keyword": connect_papers_to_keywords, "specializes_in": connect_authors_to_keywords, "focuses_on": connect_journals_to_keywords, "temporal_proximity": connect_years}
    of = lambda kind: edges if sources is None else edges.filter(F.col("source_graph").isin(list(sources[kind])))
    return unite([edges, *[connect(nodes, of(kind)) for kind, connect in connectors.items()]])


def unified_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form (metric, key, value): types, abstract quality, and what each source gave."""
    papers = nodes.filter(F.col("node_type") == "paper")
    edges = durable(edges.groupBy("edge_type", "source_graph").agg(F.count("*").alias("_n")))  # two counts from one pass
    many = lambda df: F.sum("_n") if "_n" in df.columns else F.count("*")
    tall = lambda df, metric, key: df.groupBy(F.col(key).alias("key")).agg(many(df).alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    totals = papers.agg(F.count_if("has_abstract").alias("with"), F.count_if(~F.col("has_abstract")).alias("without"), F.coalesce(F.sum("abstract_length"), F.lit(0)).alias("length"))
    return unite(
        [
            tall(nodes, "node_types", "node_type"),
            tall(edges, "edge_types", "edge_type"),
            tall(papers, "abstract_quality", "abstract_quality"),
            tall(nodes.select(F.explode("source_graphs").alias("s")), "source_nodes", "s"),
            tall(edges, "source_edges", "source_graph"),
            totals.unpivot([], ["with", "without", "length"], "key", "value").select(F.lit("abstracts").alias("metric"), "key", "value"),
        ]
    )


def graph_structure(nodes: DataFrame, samples: int = 3) -> DataFrame:
    """Nodes per type with the first few ids of each."""
    first = top_per_group(nodes.select("node_type", "id"), ["node_type"], [F.asc("id")], samples)
    listed = first.groupBy("node_type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes")).join(listed, "node_type")


def keep_last_edges(edges: DataFrame) -> DataFrame:
    """Edges equal in ends and type collapse to the one loaded last (``seq``)."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "edge_type", "seq")]
    kept = edges.groupBy("src", "dst", "edge_type").agg(F.max_by(F.struct(F.lit(1).alias("_"), *rest), "seq").alias("e"))
    return kept.select("src", "dst", "edge_type", *[F.col(f"e.{c}").alias(c) for c in rest])
