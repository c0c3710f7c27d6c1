"""Catalogue: the unified graph and the subgraphs grown from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarweave.operators import authors, components, expansion, keywords, unify, vectors
from scholarweave.operators.ranking import top_per_group
from scholarweave.plans.builders import citation_graph
from scholarweave.plans.search import E_, Q_, SIM, label_queries
from scholarweave.plans.sql_views import AUTH, CITES, COLLAB, FLAGS, KW, PAPERS, with_views
from scholarweave.session import durable
from scholarweave.sources import tables as t


def paper_node(column):
    return F.concat(F.lit("paper_"), F.col(column).cast("string"))


def author_node(column):
    return F.concat(F.lit("author_"), F.col(column).cast("string"))


def source_graphs(spark, d):
    """(name, nodes, edges) of the six source graphs over the domain views.

    Edges are functions: those that rank or search run jobs, which a node query does without.
    """
    papers, authorship, kw = t.papers(spark, d), t.authorship(spark, d), t.paper_keywords(spark, d)
    listed = kw.groupBy("paper_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    paper = paper_node("paper_id").alias("id")
    kind = lambda k: F.lit(k).alias("node_type")
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("abstract"))
    counts = authorship.groupBy("author_id").agg(F.count("*").alias("paper_count"))
    first = authors.with_author_flags(authorship).groupBy("author_id").agg(F.count("*").alias("paper_count"), F.count_if("is_first").alias("first_author_count"))
    journals = papers.groupBy("journal").agg(F.count("*").alias("paper_count"))
    none = F.lit(None).cast("double").alias("weight")
    return [
        (
            "citation", papers.join(listed, "paper_id", "left").select(paper, kind("paper"), "title", "year", "journal", "keywords"),
            lambda: citation_graph(spark, d)[0].select(paper_node("citing_id").alias("src"), paper_node("cited_id").alias("dst"), F.lit("citation").alias("edge_type"), none),
        ),
        (
            "keyword", keywords.keyword_frequency(kw).filter("freq >= 2").select(F.col("keyword").alias("id"), kind("keyword"), F.col("freq").alias("frequency")),
            lambda: keywords.cooccurrence_edges(kw).select(F.col("keyword1").alias("src"), F.col("keyword2").alias("dst"), "weight"),
        ),
        (
            "semantic", papers.join(docs, "paper_id").select(paper, kind("paper"), "title", "year", "abstract"),
            lambda: vectors.neighbours(t.vectors(spark, d), 3).select(paper_node("src").alias("src"), paper_node("dst").alias("dst"), F.lit("semantic_similarity").alias("edge_type"), F.col("similarity").alias("weight")),
        ),
        (
            "author_collab", counts.select(author_node("author_id").alias("id"), kind("author"), "paper_count"),
            lambda: authors.collaboration_edges(authorship).select(author_node("author1").alias("src"), author_node("author2").alias("dst"), F.lit("collaboration").alias("edge_type"), F.col("collaboration_count").alias("weight")),
        ),
        (
            "author_paper",
            unify.unite([
                first.select(author_node("author_id").alias("id"), kind("author"), "paper_count", "first_author_count"),
                papers.select(paper, kind("paper"), "title", "year"),
            ]),
            lambda: authorship.select(author_node("author_id").alias("src"), paper_node("paper_id").alias("dst"), F.lit("authored").alias("edge_type"), F.lit(1.0).alias("weight")),
        ),
        (
            "journal_paper",
            unify.unite([
                journals.select(F.col("journal").alias("id"), kind("journal"), "paper_count"),
                papers.join(listed, "paper_id", "left").select(paper, kind("paper"), "title", "year", "keywords"),
            ]),
            lambda: papers.select(paper_node("paper_id").alias("src"), F.col("journal").alias("dst"), F.lit("published_in").alias("edge_type"), F.lit(1.0).alias("weight")),
        ),
    ]


def unified_nodes(spark, d):
    return unify.merge_nodes(unify.unite([unify.standardize_nodes(n, name) for name, n, _ in source_graphs(spark, d)]))


def unified_edges(spark, d, *only):
    """Edges of all sources, or of those named."""
    return unify.unite([unify.standardize_edges(e(), name) for name, _, e in source_graphs(spark, d) if not only or name in only])


def unify_nodes(spark, d):
    return unified_nodes(spark, d).select(
        "id", "node_type", F.array_join("source_graphs", ",").alias("source_graphs"), "title", "year", "journal", "name", "paper_count",
        "first_author_count", "frequency", "abstract_length", "abstract_quality", "keyword_count", "ml_relevance_score", "battery_relevance_score",
    )


def unify_edges(spark, d):
    return unified_edges(spark, d).select("src", "dst", "edge_key", F.round("normalized_weight", 6).alias("normalized_weight"))


def _cross(spark, d, connect, *sources):
    """New edges of one connector, from the sources whose edges it follows or could repeat (those between the same kinds of nodes)."""
    nodes = durable(unified_nodes(spark, d).select("id", "node_type", "keywords", "year"))
    return connect(nodes, unified_edges(spark, d, *sources)).select("src", "dst", F.round("weight", 6).alias("weight"))


CROSS_SOURCES = {"has_keyword": ["author_paper", "journal_paper"], "specializes_in": ["author_paper"], "focuses_on": ["journal_paper"], "temporal_proximity": ["citation", "semantic"]}


def cross_has_keyword(spark, d):
    return _cross(spark, d, unify.connect_papers_to_keywords, *CROSS_SOURCES["has_keyword"])


def cross_specializes_in(spark, d):
    return _cross(spark, d, unify.connect_authors_to_keywords, *CROSS_SOURCES["specializes_in"])


def cross_focuses_on(spark, d):
    return _cross(spark, d, unify.connect_journals_to_keywords, *CROSS_SOURCES["focuses_on"])


def temporal_proximity(spark, d):
    return _cross(spark, d, unify.connect_years, *CROSS_SOURCES["temporal_proximity"])


def unified_stats(spark, d):
    nodes = unified_nodes(spark, d).select("id", "node_type", "keywords", "year", "source_graphs", "abstract_quality", "has_abstract", "abstract_length")
    nodes, edges = durable(nodes), durable(unified_edges(spark, d).select("src", "dst", "edge_type", "source_graph"))
    return unify.unified_statistics(nodes, unify.add_cross_edges(nodes, edges, CROSS_SOURCES))


def graph_structure(spark, d):
    return unify.graph_structure(unified_nodes(spark, d))


# --- subgraphs ---------------------------------------------------------------------------


def literature(spark, d):
    """Nodes and edges (citations, authorship, journals) on which the subgraphs are grown."""
    papers = t.papers(spark, d)
    cites, _ = citation_graph(spark, d)
    nodes = unify.unite([
        papers.select(paper_node("paper_id").alias("id"), F.lit("paper").alias("node_type"), "title", "year", "journal"),
        t.table(spark, d, "supplier").select(author_node("s_suppkey").alias("id"), F.lit("author").alias("node_type"), F.col("s_name").alias("name")),
        t.table(spark, d, "nation").select(F.col("n_name").alias("id"), F.lit("journal").alias("node_type"), F.col("n_name").alias("name")),
    ])
    edges = unify.unite([
        cites.select(paper_node("citing_id").alias("src"), paper_node("cited_id").alias("dst"), F.lit("cites").alias("edge_type")),
        t.authorship(spark, d).select(author_node("author_id").alias("src"), paper_node("paper_id").alias("dst"), F.lit("authored_by").alias("edge_type")),
        papers.select(paper_node("paper_id").alias("src"), F.col("journal").alias("dst"), F.lit("published_in").alias("edge_type")),
    ])
    return nodes, edges


def named(spark, d):
    """(id, node_type, title, name) of the nodes of ``described``, without the attributes that others show."""
    nodes, _ = literature(spark, d)
    words = t.paper_keywords(spark, d).select("keyword").distinct()
    full = unify.unite([nodes.select("id", "node_type", "title", "name"), words.select(F.col("keyword").alias("id"), F.lit("keyword").alias("node_type"), F.col("keyword").alias("name"))])
    return full.join(_texts(spark, d).select("id"), "id", "left")  # a paper with several texts stands there as often


def _texts(spark, d):
    return t.table(spark, d, "documents").select(paper_node("doc_id").alias("id"), F.col("text").alias("abstract"))


def described(spark, d, only=None):
    """``literature`` with keyword nodes, and the attributes that contexts show: authors, abstract and keywords of papers, counts and topics of the others.

    ``only`` (id) names the nodes that are wanted; what is added to others is then not gathered.
    """
    nodes, edges = literature(spark, d)
    authorship, words, published = t.authorship(spark, d), t.paper_keywords(spark, d), t.papers(spark, d)
    wanted = lambda df, node: df if only is None else df.join(only.select(F.col("id").alias("_only")), node == F.col("_only"), "left_semi")
    names = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_name")
    listed = lambda df, key, order, value: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_l"))
    people = listed(wanted(authorship, paper_node("paper_id")).join(names, "author_id"), "paper_id", "line", "s_name").select(paper_node("paper_id").alias("id"), F.col("_l").alias("authors"))
    terms = listed(wanted(words, paper_node("paper_id")), "paper_id", "line", "keyword").select(paper_node("paper_id").alias("id"), F.col("_l").alias("keywords"))
    texts = _texts(spark, d)
    written = wanted(authorship, author_node("author_id"))
    counts = written.groupBy("author_id").agg(F.count("*").alias("paper_count")).select(author_node("author_id").alias("id"), "paper_count")
    published = wanted(published, F.col("journal")).groupBy(F.col("journal").alias("id")).agg(F.count("*").alias("paper_count"))
    topics = written.join(words, "paper_id").groupBy("author_id", "keyword").agg(F.count("*").alias("n"))
    topics = top_per_group(topics, ["author_id"], [F.desc("n"), F.asc("keyword")], 5)
    topics = listed(topics, "author_id", "rank", "keyword").select(author_node("author_id").alias("id"), F.col("_l").alias("top_keywords"))
    frequency = wanted(words, F.col("keyword")).groupBy(F.col("keyword").alias("id")).agg(F.count("*").alias("frequency"))
    keyword_nodes = frequency.select("id", F.lit("keyword").alias("node_type"), F.col("id").alias("name"))
    full = wanted(unify.unite([nodes, keyword_nodes]), F.col("id"))
    for part in (people, terms, texts, counts.unionByName(published), topics, frequency):
        full = full.join(part, "id", "left")
    has = words.select(paper_node("paper_id").alias("src"), F.col("keyword").alias("dst"), F.lit("has_keyword").alias("edge_type"))
    return full.withColumn("productivity_type", F.lit(None).cast("string")), unify.unite([edges, has])


def store(spark, d):
    return t.vectors(spark, d).withColumn("node_id", paper_node("node_id"))


def seeds(spark, d, k=5):
    found = vectors.search(store(spark, d), label_queries(spark, d), k, min_similarity=0.2)
    return durable(found.select("query_id", "node_id", "similarity"))


def degree_centrality(nodes, edges):
    from scholarweave.operators.graph_stats import degrees

    return degrees(nodes, edges).select(F.col("id").alias("node_id"), F.col("degree_centrality").alias("centrality"))


def bfs_local(spark, d):
    _, edges = literature(spark, d)
    return expansion.expand_local(seeds(spark, d), expansion.neighbours(durable(edges.select("src", "dst")), distinct=False))


def expand_global(spark, d):
    nodes, edges = literature(spark, d)
    edges = durable(edges)
    return expansion.expand_global(seeds(spark, d), expansion.neighbours(edges, distinct=False), durable(degree_centrality(nodes, edges)))


def expand_community(spark, d):
    edges, papers = citation_graph(spark, d)
    links = edges.select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"))
    labels = components.connected_components(papers.select(F.col("paper_id").alias("id")), links)
    named = labels.select(paper_node("id").alias("id"), "component").withColumnRenamed("component", "community")
    return expansion.expand_community(seeds(spark, d), named)


def expand_temporal(spark, d):
    nodes, _ = literature(spark, d)
    return expansion.expand_temporal(seeds(spark, d), nodes)


def expand_semantic(spark, d):
    return expansion.expand_semantic(seeds(spark, d), store(spark, d), max_nodes=30, threshold=0.25)


def expand_hybrid(spark, d):
    nodes, edges = literature(spark, d)
    edges = durable(edges)
    around = expansion.neighbours(edges, distinct=False)
    return expansion.expand_hybrid(seeds(spark, d), around, store(spark, d), durable(degree_centrality(nodes, edges)), threshold=0.25)


def expansion_path(spark, d):
    return expansion.expansion_path(bfs_local(spark, d))


def local_subgraph(spark, d):
    """(nodes, edges, members, seeds) of the local strategy."""
    nodes, edges = literature(spark, d)
    edges = durable(edges)
    found = seeds(spark, d)
    return nodes, edges, durable(expansion.expand_local(found, expansion.neighbours(edges, distinct=False))), found


def induced_subgraph(spark, d):
    _, edges, members, _ = local_subgraph(spark, d)
    return expansion.induced_edges(members, edges).select("query_id", "src", "dst", "edge_type", "edge_no")


def relevance_scores(spark, d):
    nodes, _, members, found = local_subgraph(spark, d)
    scored = expansion.relevance(members, nodes, found)
    return scored.select("query_id", "node_id", F.round("relevance", 6).alias("relevance"))


def confidence_score(spark, d):
    nodes, _, members, found = local_subgraph(spark, d)
    out = expansion.confidence(expansion.relevance(members, nodes, found), found)
    return out.select("query_id", "total_nodes", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        unify_nodes, unify_edges, cross_has_keyword, cross_specializes_in, cross_focuses_on, temporal_proximity, unified_stats,
        graph_structure, bfs_local, expand_global, expand_community, expand_temporal, expand_semantic, expand_hybrid,
        expansion_path, induced_subgraph, relevance_scores, confidence_score,
    )
}

NODES = """nodes AS (
  SELECT 'paper_' || paper_id AS id, 'paper' AS node_type, CASE WHEN doc_id IS NULL THEN 'author_paper,citation,journal_paper' ELSE 'author_paper,citation,journal_paper,semantic' END AS source_graphs,
    title, year, journal, NULL AS name, CAST(NULL AS BIGINT) AS paper_count, CAST(NULL AS BIGINT) AS first_author_count, CAST(NULL AS BIGINT) AS frequency, length(coalesce(trim(text, chr(32) || chr(10) || chr(9)), '')) AS al, coalesce(nk, 0) AS keyword_count
  FROM papers LEFT JOIN documents ON doc_id = paper_id LEFT JOIN (SELECT paper_id AS kp, count(*) AS nk FROM kw GROUP BY 1) ON kp = paper_id
  UNION ALL SELECT keyword, 'keyword', 'keyword', '', NULL, NULL, keyword, NULL, NULL, count(*), 0, 0 FROM kw GROUP BY keyword HAVING count(*) >= 2
  UNION ALL SELECT 'author_' || author_id, 'author', 'author_collab,author_paper', '', NULL, NULL, 'author_' || author_id, count(*), count(*) FILTER (pos = 0), NULL, 0, 0 FROM flags GROUP BY author_id
  UNION ALL SELECT journal, 'journal', 'journal_paper', '', NULL, NULL, journal, count(*), NULL, NULL, 0, 0 FROM papers GROUP BY journal)"""
NEAR3 = f"""{E_}, {SIM}, nn AS MATERIALIZED (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rk FROM s) WHERE rk <= 3 AND sim > 0)"""
EDGES = """edges AS (
  SELECT 'paper_' || citing_id AS src, 'paper_' || cited_id AS dst, 'citation_cites' AS edge_key, 1.0::DOUBLE AS w FROM cites
  UNION ALL SELECT a.keyword, b.keyword, 'keyword_co_occurs_with', CASE WHEN count(*) > 1 THEN least(1.0, count(*) / 100.0) ELSE 1.0 END FROM kw a JOIN kw b ON a.paper_id = b.paper_id AND a.keyword < b.keyword
     WHERE a.keyword IN (SELECT keyword FROM kw GROUP BY 1 HAVING count(*) >= 2) AND b.keyword IN (SELECT keyword FROM kw GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1, 2 HAVING count(*) >= 2
  UNION ALL SELECT 'paper_' || src, 'paper_' || dst, 'semantic_semantically_similar_to', sim FROM nn
  UNION ALL SELECT 'author_' || author1, 'author_' || author2, 'author_collab_collaborates_with', CASE WHEN collaboration_count > 1 THEN least(1.0, collaboration_count / 100.0) ELSE 1.0 END FROM collab
  UNION ALL SELECT 'author_' || author_id, 'paper_' || paper_id, 'author_paper_authored_by', 1.0 FROM auth
  UNION ALL SELECT 'paper_' || paper_id, journal, 'journal_paper_published_in', 1.0 FROM papers)"""
HAS = "has AS (SELECT 'paper_' || paper_id AS src, keyword AS dst, 1.0::DOUBLE AS weight FROM kw JOIN freq USING (keyword))"
FREQ = "freq AS (SELECT keyword FROM kw GROUP BY 1 HAVING count(*) >= 2)"
SPEC = """spec AS (SELECT 'author_' || author_id AS src, keyword AS dst, round(least(1.0, count(*) / 10.0), 6)::DOUBLE AS weight
  FROM auth JOIN kw USING (paper_id) WHERE keyword IN (SELECT keyword FROM freq) GROUP BY author_id, keyword HAVING count(*) >= 2)"""
FOCUS = """jc AS (SELECT journal, keyword, count(*) AS f FROM papers JOIN kw USING (paper_id) GROUP BY 1, 2),
jr AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY f DESC, keyword) AS rk, count(*) OVER (PARTITION BY journal) AS n, max(f) OVER (PARTITION BY journal) AS mx FROM jc),
focus AS (SELECT journal AS src, keyword AS dst, round(f / mx, 6) AS weight FROM jr WHERE rk <= greatest(5, n // 5) AND keyword IN (SELECT keyword FROM freq))"""
NEARYEAR = """yr AS (SELECT 'paper_' || paper_id AS id, year, row_number() OVER (PARTITION BY year ORDER BY 'paper_' || paper_id) AS rn FROM papers),
ty AS (SELECT a.id AS src, b.id AS dst, 0.1::DOUBLE AS weight FROM yr a JOIN yr b ON a.year = b.year AND b.rn > a.rn AND b.rn <= a.rn + 10
  WHERE NOT EXISTS (SELECT 1 FROM cites WHERE 'paper_' || citing_id = a.id AND 'paper_' || cited_id = b.id)
    AND NOT EXISTS (SELECT 1 FROM nn WHERE 'paper_' || nn.src = a.id AND 'paper_' || nn.dst = b.id))"""
QUALITY = "CASE WHEN al > 100 THEN 'good' WHEN al > 50 THEN 'fair' WHEN al > 0 THEN 'poor' ELSE 'none' END"

# --- subgraphs in SQL
SEEDS = f"""{E_}, {Q_}, sr AS (SELECT query_id, 'paper_' || id AS node_id, list_cosine_similarity(q.v, e.v) AS sim,
   row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, 'paper_' || id) AS rk FROM q, e),
seeds AS MATERIALIZED (SELECT query_id, node_id, sim FROM sr WHERE rk <= 5 AND sim >= 0.2)"""
LIT = """lit AS MATERIALIZED (SELECT 'paper_' || citing_id AS src, 'paper_' || cited_id AS dst, 'cites' AS edge_type FROM cites
  UNION ALL SELECT 'author_' || author_id, 'paper_' || paper_id, 'authored_by' FROM auth
  UNION ALL SELECT 'paper_' || paper_id, journal, 'published_in' FROM papers),
around AS MATERIALIZED (SELECT src AS a, dst AS b FROM lit UNION SELECT dst, src FROM lit)"""


def hops(n, limit=200):
    out = ["m0 AS MATERIALIZED (SELECT query_id, node_id, 0 AS hop FROM seeds)"]
    for i in range(1, n + 1):
        out.append(
            f"""m{i} AS MATERIALIZED (SELECT * FROM m{i - 1} UNION ALL
  SELECT query_id, node_id, {i} FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS rn FROM
    (SELECT DISTINCT m.query_id, b AS node_id FROM m{i - 1} m JOIN around ON a = m.node_id WHERE m.hop = {i - 1}
       AND NOT EXISTS (SELECT 1 FROM m{i - 1} x WHERE x.query_id = m.query_id AND x.node_id = b)) c)
  WHERE rn <= {limit} - (SELECT count(*) FROM m{i - 1} y WHERE y.query_id = query_id))""".replace("y.query_id = query_id)", "y.query_id = z.query_id)").replace(
                "ORDER BY node_id) AS rn FROM\n", "ORDER BY node_id) AS rn FROM\n").replace(") c)\n", ") c) z\n").replace("SELECT query_id, node_id, " + str(i) + " FROM", "SELECT z.query_id, z.node_id, " + str(i) + " FROM")
        )
    return ", ".join(out)


LOCAL = with_views(PAPERS, AUTH, CITES, SEEDS, LIT, hops(3))
TYPEW = "CASE WHEN node_id LIKE 'paper_%' THEN 1.0 WHEN node_id LIKE 'author_%' THEN 0.8 ELSE 0.5 END"
REL = f"""rel AS (SELECT m3.query_id, m3.node_id, least(1.0, coalesce(sim, 0) * 0.4 + {TYPEW.replace('node_id', 'm3.node_id')} * 0.3) AS relevance
  FROM m3 LEFT JOIN seeds ON seeds.query_id = m3.query_id AND seeds.node_id = m3.node_id)"""


SQL = {
    "unify_nodes": with_views(PAPERS, AUTH, FLAGS, KW, NODES) + f"""
SELECT id, node_type, source_graphs, title, year, journal, name, paper_count, first_author_count, frequency, CAST(al AS INTEGER) AS abstract_length, {QUALITY} AS abstract_quality,
  CAST(keyword_count AS INTEGER) AS keyword_count, CAST(0 AS INTEGER) AS ml_relevance_score, 
  CAST(CASE WHEN node_type = 'paper' AND contains(lower(coalesce((SELECT text FROM documents WHERE 'paper_' || doc_id = nodes.id), '')), 'soc') THEN 1 ELSE 0 END AS INTEGER) AS battery_relevance_score FROM nodes""",
    "unify_edges": with_views(PAPERS, AUTH, COLLAB, KW, CITES, NEAR3, EDGES) + " SELECT src, dst, edge_key, round(w, 6)::DOUBLE AS normalized_weight FROM edges",
    "cross_has_keyword": with_views(KW, FREQ, HAS) + " SELECT src, dst, weight FROM has",
    "cross_specializes_in": with_views(AUTH, KW, FREQ, SPEC) + " SELECT src, dst, weight FROM spec",
    "cross_focuses_on": with_views(PAPERS, KW, FREQ, FOCUS) + " SELECT src, dst, weight FROM focus",
    "temporal_proximity": with_views(PAPERS, CITES, NEAR3, NEARYEAR) + " SELECT src, dst, weight FROM ty",
    "unified_stats": with_views(PAPERS, AUTH, FLAGS, COLLAB, KW, CITES, NEAR3, NODES, EDGES, FREQ, HAS, SPEC, FOCUS, NEARYEAR) + f""",
ae AS (SELECT edge_key FROM edges UNION ALL SELECT 'cross_connection_has_keyword' FROM has UNION ALL SELECT 'cross_connection_specializes_in' FROM spec
  UNION ALL SELECT 'cross_connection_focuses_on' FROM focus UNION ALL SELECT 'cross_connection_temporal_proximity' FROM ty),
te AS (SELECT CASE WHEN edge_key LIKE 'author_collab%' THEN 'author_collab' WHEN edge_key LIKE 'author_paper%' THEN 'author_paper' WHEN edge_key LIKE 'journal_paper%' THEN 'journal_paper'
  WHEN edge_key LIKE 'cross_connection%' THEN 'cross_connection' ELSE split_part(edge_key, '_', 1) END AS s, edge_key FROM ae)
SELECT 'node_types' AS metric, node_type AS key, count(*) AS value FROM nodes GROUP BY 2
UNION ALL SELECT 'edge_types', substr(edge_key, length(s) + 2), count(*) FROM te GROUP BY 2
UNION ALL SELECT 'abstract_quality', {QUALITY}, count(*) FROM nodes WHERE node_type = 'paper' GROUP BY 2
UNION ALL SELECT 'source_nodes', s, count(*) FROM (SELECT unnest(string_split(source_graphs, ',')) AS s FROM nodes) GROUP BY 2
UNION ALL SELECT 'source_edges', s, count(*) FROM te GROUP BY 2
UNION ALL SELECT 'abstracts', 'with', count(*) FROM nodes WHERE node_type = 'paper' AND al > 0
UNION ALL SELECT 'abstracts', 'without', count(*) FROM nodes WHERE node_type = 'paper' AND al = 0
UNION ALL SELECT 'abstracts', 'length', CAST(sum(al) AS BIGINT) FROM nodes WHERE node_type = 'paper'""",
    "graph_structure": with_views(PAPERS, AUTH, FLAGS, KW, NODES) + """, r AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY id) AS rn FROM nodes)
SELECT node_type, count(*) AS nodes, string_agg(id, ',' ORDER BY id) FILTER (rn <= 3) AS samples FROM r GROUP BY 1""",
    "bfs_local": LOCAL + " SELECT query_id, node_id, CAST(hop AS INTEGER) AS hop FROM m3",
    "expand_community": with_views(SEEDS) + """, own AS (SELECT 'paper_' || o_orderkey AS node_id, o_custkey AS c FROM orders),
w AS (SELECT DISTINCT query_id, c FROM seeds JOIN own USING (node_id)),
f AS (SELECT w.query_id, own.node_id, row_number() OVER (PARTITION BY w.query_id ORDER BY own.node_id) AS rn FROM w JOIN own USING (c)
  WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.query_id = w.query_id AND seeds.node_id = own.node_id))
SELECT query_id, node_id, 0::INTEGER AS hop FROM seeds UNION ALL
SELECT query_id, node_id, 1 FROM f WHERE rn <= 200 - (SELECT count(*) FROM seeds WHERE seeds.query_id = f.query_id)""",
    "expand_temporal": with_views(PAPERS, SEEDS) + """, y AS (SELECT 'paper_' || paper_id AS node_id, year FROM papers),
sp AS (SELECT query_id, min(year) AS lo, max(year) AS hi, greatest(3, max(year) - min(year) + 2) AS w FROM seeds JOIN y USING (node_id) GROUP BY 1),
f AS (SELECT sp.query_id, y.node_id, row_number() OVER (PARTITION BY sp.query_id ORDER BY y.node_id) AS rn FROM sp JOIN y ON y.year BETWEEN lo - w AND hi + w
  WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.query_id = sp.query_id AND seeds.node_id = y.node_id))
SELECT query_id, node_id, 0::INTEGER AS hop FROM seeds UNION ALL
SELECT query_id, node_id, 1 FROM f WHERE rn <= 200 - (SELECT count(*) FROM seeds WHERE seeds.query_id = f.query_id)""",
    "expand_semantic": with_views(SEEDS) + """, sv AS (SELECT query_id, v FROM seeds JOIN e ON node_id = 'paper_' || id),
mv AS (SELECT query_id, list(m::DOUBLE ORDER BY p) AS v FROM (SELECT query_id, p, avg(x)::FLOAT AS m FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM sv) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT query_id, 'paper_' || id AS node_id, list_cosine_similarity(mv.v, e.v) AS sim FROM mv, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, node_id) AS rk FROM c),
f AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rn FROM r WHERE rk <= 30 AND sim >= 0.25
  AND NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.query_id = r.query_id AND seeds.node_id = r.node_id))
SELECT query_id, node_id, 0::INTEGER AS hop FROM seeds UNION ALL
SELECT query_id, node_id, 1 FROM f WHERE rn <= 30 - (SELECT count(*) FROM seeds WHERE seeds.query_id = f.query_id)""",
    "expansion_path": LOCAL + """ , g AS (SELECT query_id, CAST(hop AS INTEGER) AS hop, count(*) AS added_nodes FROM m3 GROUP BY 1, 2)
SELECT *, CAST(sum(added_nodes) OVER (PARTITION BY query_id ORDER BY hop) AS BIGINT) AS total_nodes FROM g""",
    "induced_subgraph": LOCAL + """, i AS (SELECT x.query_id, src, dst, edge_type, row_number() OVER (PARTITION BY x.query_id ORDER BY src, dst, edge_type) AS rn
  FROM lit JOIN m3 x ON x.node_id = src JOIN m3 y ON y.node_id = dst AND y.query_id = x.query_id)
SELECT query_id, src, dst, edge_type, CAST(rn AS INTEGER) AS edge_no FROM i WHERE rn <= 500""",
    "relevance_scores": LOCAL + f", {REL} SELECT query_id, node_id, round(relevance, 6)::DOUBLE AS relevance FROM rel",
    "confidence_score": LOCAL + f""", {REL}, z AS (SELECT query_id, count(*) AS n, avg(relevance) AS r FROM rel GROUP BY 1), sm AS (SELECT query_id, avg(sim) AS s FROM seeds GROUP BY 1)
SELECT query_id, n AS total_nodes, round(least(1.0, s * 0.4 + r * 0.4 + CASE WHEN n < 5 THEN 0.7 WHEN n > 100 THEN 0.8 ELSE 1.0 END * 0.2), 6)::DOUBLE AS confidence FROM z JOIN sm USING (query_id)""",
}
