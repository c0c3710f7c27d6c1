"""Every registered query against its SQL on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from verify import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
FAST = [
    "keyword_cooccurrence", "keyword_table", "author_collaboration", "author_common_papers", "author_stats", "author_paper_edges", "paper_stats",
    "journal_stats", "citation_lag", "collaboration_strength", "text_clean", "frequent_terms", "title_extract", "keywords_section",
    "abstract_extract", "reference_fields", "bibtex_parse", "parsing_stats", "integrate_metadata", "citation_match_contains",
    "knn_topk_per_node", "vector_search_filtered", "pairwise_similarity", "semantic_edges_ranked", "connected_components", "clustering_coefficient",
    "text_encoding", "unify_nodes", "cross_focuses_on", "temporal_proximity", "bfs_local", "expand_semantic", "induced_subgraph",
    "query_entities", "query_complexity", "query_plan", "memory_relevance", "memory_hybrid", "session_summary", "stream_sessions",
    "scc_sizes", "memory_kinds", "kept_histories", "stream_kept_cache", "ivf_assignment", "ivf_search", "ivf_recall", "question_seeds", "memory_window", "memory_stats", "graph_analyses", "embedding_updates",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    cur = duck.execute(entry.oracle_sql()[name])
    problem = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [c[0] for c in cur.description])
    assert problem is None, problem
