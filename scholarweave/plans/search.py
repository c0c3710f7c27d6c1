"""Catalogue: vectors, similarity graphs and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarweave.functions import encoding
from scholarweave.operators import centrality, communities, components, graph_analysis, graph_stats, ivf, vectors
from scholarweave.operators.ranking import distribution, group_rank
from scholarweave.plans.builders import citation_graph, collaboration_graph
from scholarweave.plans.sql_views import AUTH, COLLAB, with_views
from scholarweave.session import durable, scratch
from scholarweave.sources import tables as t


def _round(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def label_queries(spark, d):
    """One query per node type: its vector of smallest id."""
    v = t.vectors(spark, d)
    return v.groupBy(F.col("node_type").alias("query_id")).agg(F.min_by("embedding", "node_id").alias("embedding"))


def knn_topk_per_node(spark, d):
    return _round(vectors.neighbours(t.vectors(spark, d), 10), "similarity")


def similarity_top_percent(spark, d):
    return _round(vectors.neighbours_percent(t.vectors(spark, d), 20.0), "similarity")


def vector_search(spark, d):
    return _round(vectors.search(t.vectors(spark, d), label_queries(spark, d), 20), "similarity")


def vector_search_filtered(spark, d):
    return _round(vectors.search(t.vectors(spark, d), label_queries(spark, d), 20, node_types=["t1", "t2", "t3"]), "similarity")


def seed_search(spark, d):
    found = vectors.search(t.vectors(spark, d), label_queries(spark, d), 20, filters={"node_type": ["t0", "t5", "t9"]}, min_similarity=0.1)
    return _round(found, "similarity")


def vector_l2(spark, d):
    return _round(vectors.search(t.vectors(spark, d), label_queries(spark, d), 10, metric="l2"), "similarity")


# These vectors are spread evenly in all directions, so most lists have to be read for nine tenths of the neighbours.
IVF_LISTS, IVF_PROBES, IVF_ROUNDS = 16, 12, 3


def vector_index(spark, d):
    """The given vectors filed under centroids of three rounds; the folder of the index."""
    store, path = t.vectors(spark, d), scratch(spark, "ivf")
    ivf.write_index(store, ivf.train(store, IVF_LISTS, IVF_ROUNDS, tolerance=0.0), path)
    return path


def ivf_assignment(spark, d):
    return spark.read.parquet(f"{vector_index(spark, d)}/vectors").select("node_id", "list")


def ivf_search(spark, d):
    return _round(ivf.search_index(spark, vector_index(spark, d), label_queries(spark, d), 10, 4), "similarity")


def ivf_recall(spark, d):
    """Share of each vector's ten nearest others that its probed lists give; the vector itself is the eleventh."""
    queries = t.vectors(spark, d).select(F.col("node_id").alias("query_id"), "embedding")
    found = ivf.search_index(spark, vector_index(spark, d), queries, 11, IVF_PROBES)
    exact = vectors.neighbours(t.vectors(spark, d), 10).select(F.col("src").alias("query_id"), F.col("dst").alias("node_id"))
    return ivf.recall(found, exact).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall"), (F.avg("recall") >= 0.9).alias("enough"))


def mean_vector_search(spark, d):
    means = vectors.mean_vector(t.vectors(spark, d).withColumnRenamed("node_type", "query_id"), ["query_id"])
    return _round(vectors.search(t.vectors(spark, d), means, 15), "similarity")


def vector_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: (x * (F.col("node_id") % 3)).cast("float"))
    unit = vectors.normalize(F.col("v"))
    rows = t.vectors(spark, d).select("node_id", scaled.alias("v"))
    return rows.select("node_id", F.round(vectors.norm(F.col("v")), 4).alias("length"), F.round(vectors.norm(unit), 4).alias("unit_length"))


def node_embedding(spark, d):
    """Lookup of stored vectors by id: every node's own vector is found through a join on ids."""
    wanted = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    rows = t.vectors(spark, d).join(wanted, "node_id", "left_semi")
    return rows.select("node_id", "node_type", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def vector_store_info(spark, d):
    return _round(vectors.store_info(t.vectors(spark, d)), "size_mb")


def embedding_counts(spark, d):
    return t.vectors(spark, d).groupBy("node_type").agg(F.count("*").alias("embeddings"))


def pairwise_similarity(spark, d):
    return _round(vectors.pairwise_moments(t.vectors(spark, d)), "mean", "std")


def similarity_distribution(spark, d):
    edges = durable(vectors.neighbours(t.vectors(spark, d), 10).select("similarity"))
    return distribution(edges, "similarity", [0.25, 0.5, 0.75, 0.9, 0.95]).select("metric", F.round("value", 6).alias("value"))


def semantic_edges_ranked(spark, d):
    """Edges with their rank per source and their running number over all sources."""
    edges = durable(vectors.neighbours(t.vectors(spark, d), 5).withColumnRenamed("rank", "source_rank"))
    return _round(group_rank(edges, [], ["src", "source_rank"], "global_rank"), "similarity")


def semantic_graph(spark, d, k):
    """The edges are stored: they are searched for once, however often they are read."""
    v = t.vectors(spark, d)
    return v.select(F.col("node_id").alias("id")), durable(vectors.neighbours(v, k).select("src", "dst"))


def semantic_degrees(spark, d):
    nodes, edges = semantic_graph(spark, d, 10)
    return _round(graph_stats.degrees(nodes, edges).select("id", "in_degree", "out_degree", "in_degree_centrality"), "in_degree_centrality")


# Cosine from which two vectors belong together.
SIMILAR = 0.35


def connected_components(spark, d):
    """Vectors joined by any pair that is similar enough, whatever the number of partners."""
    v = t.vectors(spark, d)
    return components.connected_components(v.select(F.col("node_id").alias("id")), vectors.linked(v, SIMILAR))


def component_sizes(spark, d):
    return components.component_sizes(connected_components(spark, d))


def citation_components(spark, d):
    edges, papers = citation_graph(spark, d)
    nodes = papers.select(F.col("paper_id").alias("id"))
    links = edges.select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"))
    return components.component_summary(components.connected_components(nodes, links))


def scc_sizes(spark, d):
    found = components.strongly_connected_components(*semantic_graph(spark, d, 1))
    return components.component_sizes(found).groupBy("size").agg(F.count("*").alias("components"))


def clustering_coefficient(spark, d):
    return _round(graph_stats.clustering(*collaboration_graph(spark, d)), "clustering")


def transitivity(spark, d):
    local = graph_stats.clustering(*collaboration_graph(spark, d))
    return _round(graph_stats.clustering_summary(local), "average_clustering", "transitivity")


# Mean change of a score below which the iteration ends; six decimals are given.
SETTLED = 1e-9


def eigenvector_centrality(spark, d):
    return _round(centrality.eigenvector_centrality(*collaboration_graph(spark, d), tolerance=SETTLED), "centrality")


def betweenness_centrality(spark, d):
    return _round(centrality.betweenness_centrality(*collaboration_graph(spark, d)), "centrality")


def betweenness_semantic(spark, d):
    """Exact, from every node, on the sparse neighbour graph."""
    return _round(centrality.betweenness_centrality(*semantic_graph(spark, d, 3)), "centrality")


def graph_analyses(spark, d):
    """The analyses of the collaboration and of the similarity graph in one table."""
    graphs = {"collaboration": collaboration_graph(spark, d), "similarity": semantic_graph(spark, d, 1)}
    return _round(graph_analysis.united(graphs), "value")


def louvain_communities(spark, d):
    return communities.communities(*semantic_graph(spark, d, 5))


def louvain_stable(spark, d):
    """Nodes of the graph with their weights and whether no move out of its community would raise modularity."""
    nodes, edges = semantic_graph(spark, d, 5)
    moves = communities.single_moves(edges, communities.communities(nodes, edges))
    return moves.select("id", F.col("k").alias("weight"), (F.col("gain") <= communities.ROUNDING * 4).alias("stable"))


def text_encoding(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", encoding.encode(F.col("text")).alias("v"))
    return rows.select("doc_id", F.posexplode("v").alias("pos", "x")).filter("x <> 0").select("doc_id", "pos", F.round(F.col("x").cast("double"), 4).alias("x"))


def chunking(spark, d):
    out = encoding.chunk_rows(t.table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_no", F.length("text").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"))


def passage_retrieval(spark, d):
    """Plain chunk retrieval: benchmark passages find their five nearest chunks."""
    pieces = encoding.chunk_rows(t.table(spark, d, "documents"), "doc_id", "text")
    store = pieces.select(
        F.concat_ws("-", F.lpad("doc_id", 12, "0"), F.lpad("chunk_no", 8, "0")).alias("node_id"), F.lit("chunk").alias("node_type"),
        encoding.encode(F.col("text")).alias("embedding"),
    )
    asked = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), encoding.encode(F.col("text")).alias("embedding"))
    return _round(vectors.search(store, asked, 5), "similarity")


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk_per_node, similarity_top_percent, ivf_assignment, ivf_search, ivf_recall, vector_search, vector_search_filtered, seed_search, vector_l2,
        mean_vector_search, vector_normalize, node_embedding, vector_store_info, embedding_counts, pairwise_similarity,
        similarity_distribution, semantic_edges_ranked, semantic_degrees, connected_components, component_sizes,
        citation_components, scc_sizes, clustering_coefficient, transitivity, eigenvector_centrality,
        betweenness_centrality, betweenness_semantic, graph_analyses, louvain_communities, louvain_stable, text_encoding, chunking, passage_retrieval,
    )
}

E_ = "e AS (SELECT vec_id AS id, 't' || label AS ty, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SIM = "s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.id <> b.id)"


def nearest(k):
    return f"""{E_}, {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rk FROM s),
nn AS MATERIALIZED (SELECT src, dst, sim, rk FROM r WHERE rk <= {k} AND sim > 0)"""


Q_ = "q AS (SELECT ty AS query_id, min_by(v, id) AS v FROM e GROUP BY 1)"


def searching(k, score="list_cosine_similarity(q.v, e.v)", where="true", queries=Q_):
    return f"""WITH {E_}, {queries}, s AS (SELECT query_id, id AS node_id, {score} AS sim FROM q, e WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, node_id) AS rk FROM s)
SELECT query_id, node_id, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= {k}"""


MEANQ = """q AS (SELECT query_id, list(CAST(m AS DOUBLE) ORDER BY p) AS v FROM
  (SELECT ty AS query_id, p, CAST(avg(x) AS FLOAT) AS m FROM (SELECT ty, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) GROUP BY 1, 2) GROUP BY 1)"""
UNDIRECTED = "u AS (SELECT src AS a, dst AS b FROM nn UNION SELECT dst, src FROM nn)"
REACH = f"""WITH RECURSIVE {E_}, {SIM}, u AS MATERIALIZED (SELECT src AS a, dst AS b FROM s WHERE NOT isnan(sim) AND round(sim, 9) >= {SIMILAR}),
w(id, root) AS (SELECT id, id FROM e UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.id),
cc AS (SELECT id, min(root) AS component FROM w GROUP BY 1)"""
WHOLE = """pairs AS MATERIALIZED (SELECT author1 AS a, author2 AS b FROM collab),
adj AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
deg AS (SELECT s_suppkey AS id, count(adj.a) AS degree FROM supplier LEFT JOIN adj ON adj.a = s_suppkey GROUP BY 1),
tri AS (SELECT x.a AS id, count(*) / 2 AS triangles FROM adj x JOIN adj y ON x.b = y.a JOIN adj z ON y.b = z.a AND z.b = x.a GROUP BY 1),
loc AS (SELECT id, degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles,
  CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1.0)) ELSE 0.0 END AS clustering FROM deg LEFT JOIN tri USING (id))"""


def filed(lists, rounds):
    """Lloyd rounds from the vectors of smallest hash: ``own`` has the list of every vector, ``cen`` the last centroids."""
    unit = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
    near = "SELECT id, u, c.list, row_number() OVER (PARTITION BY id ORDER BY round(list_inner_product(u, c.v), 9) DESC, c.list) AS r FROM n, {c} c"
    steps = [E_, f"n AS MATERIALIZED (SELECT id, ty, {unit.format(v='v')} AS u FROM e WHERE list_sum(list_transform(v, lambda y: y * y)) > 0)",
             f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS INTEGER) - 1 AS list, u AS v FROM n ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT {lists})"]
    for i in range(rounds):
        steps.append(f"a{i} AS ({near.format(c=f'c{i}')} QUALIFY r = 1)")
        steps.append(f"s{i} AS (SELECT list, list(x ORDER BY p) AS v FROM (SELECT list, p, sum(x) AS x FROM (SELECT list, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM a{i}) GROUP BY 1, 2) GROUP BY 1)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.list, CASE WHEN s{i}.v IS NULL THEN c{i}.v ELSE {unit.format(v=f's{i}.v')} END AS v FROM c{i} LEFT JOIN s{i} USING (list))")
    steps.append(f"ranked AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    steps.append("own AS (SELECT id, u, list FROM ranked WHERE r = 1)")
    return ",\n".join(steps)


def power_rounds(n):
    """n rounds of the iteration, and the first of them whose total change is below ``SETTLED`` for each node."""
    steps = ["x0 AS (SELECT s_suppkey AS id, 1.0::DOUBLE / (SELECT count(*) FROM supplier) AS x, NULL::DOUBLE AS change FROM supplier)"]
    for i in range(n):
        steps.append(f"y{i} AS MATERIALIZED (SELECT id, x, x + coalesce((SELECT sum(o.x) FROM adj JOIN x{i} o ON o.id = adj.b WHERE adj.a = x{i}.id), 0) AS y FROM x{i})")
        steps.append(f"x{i + 1} AS MATERIALIZED (SELECT id, y / l AS x, sum(abs(y / l - x)) OVER () AS change FROM y{i}, (SELECT sqrt(sum(y * y)) AS l FROM y{i}))")
    tried = " UNION ALL ".join(f"SELECT {i} AS round, * FROM x{i}" for i in range(1, n + 1))
    return ", ".join(steps) + f""", tried AS MATERIALIZED ({tried})
SELECT id, round(x, 6) AS centrality FROM tried WHERE round = (SELECT min(round) FROM tried WHERE change < {SETTLED} * (SELECT count(*) FROM supplier))"""


# Dependencies through explicit distances and path counts (the graph's diameter is small).
BETWEEN = """d1 AS (SELECT a AS s, b AS t FROM adj),
p2 AS MATERIALIZED (SELECT x.a AS s, y.b AS t, count(*) AS paths FROM adj x JOIN adj y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = x.a AND z.b = y.b) GROUP BY 1, 2),
d3 AS (SELECT count(*) AS far FROM (SELECT p2.s, adj.b FROM p2 JOIN adj ON p2.t = adj.a WHERE p2.s <> adj.b
   AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = p2.s AND z.b = adj.b) AND NOT EXISTS (SELECT 1 FROM p2 z WHERE z.s = p2.s AND z.t = adj.b))),
c AS (SELECT x.b AS id, sum(1.0 / p2.paths) AS dep FROM p2 JOIN adj x ON x.a = p2.s JOIN adj y ON y.a = x.b AND y.b = p2.t GROUP BY 1)
SELECT s_suppkey AS id, round(coalesce(dep, 0) / ((n - 1.0) * (n - 2.0)), 6) AS centrality FROM supplier LEFT JOIN c ON id = s_suppkey, (SELECT count(*) AS n FROM supplier), d3
WHERE far = 0"""



def analysed(graph):
    """The measures of ``graph`` (views <graph>_n of id and <graph>_e of a < b)."""
    return f"""{graph}_u AS (SELECT a, b FROM {graph}_e UNION ALL SELECT b, a FROM {graph}_e),
{graph}_d AS MATERIALIZED (SELECT id, count(u.b) AS degree FROM {graph}_n LEFT JOIN {graph}_u u ON u.a = id GROUP BY 1),
{graph}_w(id, root) AS (SELECT id, id FROM {graph}_n UNION SELECT u.b, w.root FROM {graph}_w w JOIN {graph}_u u ON u.a = w.id),
{graph}_c AS MATERIALIZED (SELECT component, count(*) AS size FROM (SELECT id, min(root) AS component FROM {graph}_w GROUP BY 1) GROUP BY 1),
{graph}_t AS (SELECT count(*)::DOUBLE AS n, sum(degree) / 2 AS m, max(degree) AS most, count(*) FILTER (degree = 0) AS alone, (SELECT count(*) FROM {graph}_c) AS parts, (SELECT max(size) FROM {graph}_c) AS largest FROM {graph}_d),
{graph}_a AS (SELECT unnest(['num_nodes', 'num_edges', 'density', 'average_degree', 'max_degree', 'isolated_nodes', 'num_components', 'largest_component', 'largest_share', 'is_connected']) AS measure,
    NULL::INTEGER AS rank, NULL::VARCHAR AS id, unnest([n, m, 2 * m / (n * (n - 1)), 2 * m / n, most, alone, parts, largest, largest / n, (parts = 1)::INTEGER]::DOUBLE[]) AS value FROM {graph}_t
  UNION ALL SELECT 'top_degree', (row_number() OVER (ORDER BY degree DESC, id))::INTEGER AS r, id::VARCHAR, degree::DOUBLE FROM {graph}_d QUALIFY r <= 10
  UNION ALL SELECT 'top_component', (row_number() OVER (ORDER BY size DESC, component))::INTEGER AS r, component::VARCHAR, size::DOUBLE FROM {graph}_c QUALIFY r <= 10)"""


def between(depth):
    """Levels of paths from every node, and their dependencies back; gives no rows if ``depth`` levels are not enough."""
    steps = ["l0 AS MATERIALIZED (SELECT id AS s, id AS t, CAST(1 AS DOUBLE) AS paths FROM e)"]
    for i in range(1, depth + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} z WHERE z.s = x.s AND z.t = u.b)" for j in (i - 1, i - 2) if j >= 0)
        steps.append(f"l{i} AS MATERIALIZED (SELECT x.s, u.b AS t, sum(x.paths) AS paths FROM l{i - 1} x JOIN u ON u.a = x.t WHERE {seen} GROUP BY 1, 2)")
    steps.append(f"b{depth} AS (SELECT *, CAST(0 AS DOUBLE) AS dep FROM l{depth})")
    for i in range(depth - 1, 0, -1):
        flow = f"SELECT w.s, u.a AS t, sum((1 + w.dep) / w.paths) AS f FROM b{i + 1} w JOIN u ON u.b = w.t GROUP BY 1, 2"
        steps.append(f"b{i} AS MATERIALIZED (SELECT x.s, x.t, x.paths, x.paths * coalesce(f, 0) AS dep FROM l{i} x LEFT JOIN ({flow}) g ON g.s = x.s AND g.t = x.t)")
    every = " UNION ALL ".join(f"SELECT t, dep FROM b{i}" for i in range(1, depth + 1))
    return ",\n".join(steps) + f""", d AS (SELECT t AS id, sum(dep) AS dep FROM ({every}) GROUP BY 1)
SELECT e.id, round(coalesce(dep, 0) / ((n - 1.0) * (n - 2.0)), 6) AS centrality FROM e LEFT JOIN d ON d.id = e.id, (SELECT count(*) AS n FROM e) WHERE NOT EXISTS (SELECT 1 FROM l{depth})"""


SQL = {
    "knn_topk_per_node": f"WITH {nearest(10)} SELECT src, dst, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM nn",
    "similarity_top_percent": f"WITH {nearest('greatest(1, (SELECT count(*) FROM e) * 20 // 100)')} SELECT src, dst, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM nn",
    "vector_search": searching(20),
    "vector_search_filtered": searching(20, where="ty IN ('t1', 't2', 't3')"),
    "seed_search": searching(20, where="ty IN ('t0', 't5', 't9')") + " AND sim >= 0.1",
    "vector_l2": searching(10, score="1 / (1 + list_distance(q.v, e.v))"),
    "ivf_assignment": f"WITH {filed(IVF_LISTS, IVF_ROUNDS)} SELECT id AS node_id, list FROM own",
    "ivf_search": f"""WITH {filed(IVF_LISTS, IVF_ROUNDS)}, q AS (SELECT min(id) AS id, ty FROM e GROUP BY 2),
f AS (SELECT q.ty AS query_id, own.id AS node_id, list_inner_product(p.u, own.u) AS sim FROM q JOIN ranked p ON p.id = q.id AND p.r <= 4 JOIN own ON own.list = p.list),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, node_id) AS rk FROM f)
SELECT query_id, node_id, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM g WHERE rk <= 10""",
    "ivf_recall": f"""WITH {filed(IVF_LISTS, IVF_ROUNDS)}, {nearest(10).removeprefix(E_ + ', ')},
f AS (SELECT p.id AS src, own.id AS dst, row_number() OVER (PARTITION BY p.id ORDER BY round(list_inner_product(p.u, own.u), 9) DESC, own.id) AS rk
  FROM ranked p JOIN own ON own.list = p.list WHERE p.r <= {IVF_PROBES}),
h AS (SELECT nn.src, count(f.dst) / count(*) AS recall FROM nn LEFT JOIN f ON f.src = nn.src AND f.dst = nn.dst AND f.rk <= 11 GROUP BY 1)
SELECT count(*) AS queries, round(avg(recall), 4) AS recall, avg(recall) >= 0.9 AS enough FROM h""",
    "graph_analyses": "WITH RECURSIVE " + with_views(AUTH, COLLAB).removeprefix("WITH ") + f""", {nearest(1)},
co_n AS (SELECT s_suppkey AS id FROM supplier), co_e AS (SELECT DISTINCT least(author1, author2) AS a, greatest(author1, author2) AS b FROM collab),
si_n AS (SELECT id FROM e), si_e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nn),
{analysed('co')}, {analysed('si')}
SELECT 'collaboration' AS graph, measure, rank, id, round(value, 6) AS value FROM co_a UNION ALL SELECT 'similarity', measure, rank, id, round(value, 6) FROM si_a""",
    "louvain_stable": f"""WITH {nearest(5)}, w AS (SELECT src AS id FROM nn UNION ALL SELECT dst FROM nn)
SELECT id, CAST(count(*) AS DOUBLE) AS weight, true AS stable FROM w GROUP BY 1""",
    "mean_vector_search": searching(15, queries=MEANQ),
    "vector_normalize": """SELECT vec_id AS node_id, round(vec_id % 3 * sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS length,
   CASE WHEN vec_id % 3 > 0 THEN 1.0::DOUBLE END AS unit_length FROM embeddings""",
    "node_embedding": "SELECT vec_id AS node_id, 't' || label AS node_type, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier)",
    "vector_store_info": """SELECT count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(DISTINCT label) AS node_types,
   round(sum(len(embedding)) * 4 / 1048576, 6) AS size_mb FROM embeddings""",
    "embedding_counts": "SELECT 't' || label AS node_type, count(*) AS embeddings FROM embeddings GROUP BY 1",
    "pairwise_similarity": f"WITH {E_}, {SIM} SELECT count(*) AS pairs, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std FROM s",
    "similarity_distribution": f"""WITH {nearest(10)} SELECT unnest(['count', 'mean', 'std', 'min', 'max', 'p25', 'p50', 'p75', 'p90', 'p95']) AS metric,
   unnest([count(*)::DOUBLE, round(avg(sim), 6), round(stddev_pop(sim), 6), round(min(sim), 6), round(max(sim), 6), round(quantile_cont(sim, 0.25), 6), round(quantile_cont(sim, 0.5), 6),
   round(quantile_cont(sim, 0.75), 6), round(quantile_cont(sim, 0.9), 6), round(quantile_cont(sim, 0.95), 6)]) AS value FROM nn""",
    "semantic_edges_ranked": f"WITH {nearest(5)} SELECT src, dst, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS source_rank, row_number() OVER (ORDER BY src, rk) AS global_rank FROM nn",
    "semantic_degrees": f"""WITH {nearest(10)} SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round(coalesce(i, 0) / ((SELECT count(*) FROM e) - 1), 6) AS in_degree_centrality
   FROM e LEFT JOIN (SELECT dst, count(*) AS i FROM nn GROUP BY 1) ON dst = id LEFT JOIN (SELECT src, count(*) AS o FROM nn GROUP BY 1) ON src = id""",
    "connected_components": REACH + " SELECT id, component FROM cc",
    "component_sizes": REACH + " SELECT component, count(*) AS size FROM cc GROUP BY 1",
    "citation_components": """SELECT count(*) AS num_components, max(n) AS largest_component, count(*) = 1 AS is_connected FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""",
    "scc_sizes": f"""WITH RECURSIVE {nearest(1)}, w(a, b) AS (SELECT src, dst FROM nn UNION SELECT w.a, nn.dst FROM w JOIN nn ON nn.src = w.b),
scc AS (SELECT id, greatest(id, coalesce((SELECT max(x.b) FROM w x JOIN w y ON y.a = x.b AND y.b = x.a WHERE x.a = e.id), id)) AS c FROM e)
SELECT size, count(*) AS components FROM (SELECT c, count(*) AS size FROM scc GROUP BY 1) GROUP BY 1""",
    "clustering_coefficient": with_views(AUTH, COLLAB, WHOLE) + " SELECT id, degree, triangles, round(clustering, 6) AS clustering FROM loc",
    "transitivity": with_views(AUTH, COLLAB, WHOLE) + """
SELECT round(avg(clustering), 6) AS average_clustering, round(sum(triangles) * 2.0 / sum(degree * (degree - 1.0)), 6) AS transitivity FROM loc""",
    "eigenvector_centrality": with_views(AUTH, COLLAB, WHOLE) + ", " + power_rounds(30),
    "betweenness_centrality": with_views(AUTH, COLLAB, WHOLE) + ", " + BETWEEN,
    "betweenness_semantic": f"WITH {nearest(3)}, {UNDIRECTED}, " + between(14),
    "text_encoding": r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS pos, CASE WHEN CAST('0x' || substr(md5(w), 8, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
b AS (SELECT doc_id, pos, CAST(sum(s) AS DOUBLE) AS x FROM h GROUP BY 1, 2)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 4) AS x FROM b WHERE x <> 0""",
}
