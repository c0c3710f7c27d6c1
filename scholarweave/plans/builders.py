"""Catalogue: keyword, author, journal and citation graphs and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarweave.operators import authors, citations, graph_stats, journals, keywords
from scholarweave.operators.ranking import distribution, group_rank
from scholarweave.plans.sql_views import AUTH, CITES, COLLAB, FLAGS, KW, PAPERS, with_views
from scholarweave.sources import tables as t


def citation_pairs(spark, d):
    """Every order cites its customer's previous order; ranks, not windows, find it."""
    orders = t.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    ranked = group_rank(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    earlier = ranked.select("o_custkey", (F.col("rank") + 1).alias("rank"), F.col("o_orderkey").alias("cited_id"))
    return ranked.join(earlier, ["o_custkey", "rank"]).select(F.col("o_orderkey").alias("citing_id"), "cited_id", F.lit(0).alias("seq"))


def citation_graph(spark, d):
    papers = t.papers(spark, d)
    return citations.citation_edges(citation_pairs(spark, d), papers), papers


def _round(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def keyword_cooccurrence(spark, d):
    return _round(keywords.cooccurrence_edges(t.paper_keywords(spark, d)), "jaccard_similarity", "normalized_weight")


def keyword_frequency_topn(spark, d):
    return keywords.top_keywords(t.paper_keywords(spark, d), 20)


def keyword_filter(spark, d):
    kw = t.paper_keywords(spark, d)
    mean = keywords.keyword_frequency(kw).select(F.floor(F.avg("freq"))).scalar()
    kept = keywords.frequent_keywords(kw, mean)
    return kept.groupBy("paper_id").agg(F.count("*").alias("filtered_keyword_count"))


def keyword_table(spark, d):
    listed = (
        t.table(spark, d, "documents")
        .select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.split("text", " ").alias("keywords"))
    )
    return keywords.paper_keyword_table(listed).select(
        "paper_id", "original_keyword_count", "clean_keyword_count", F.array_join("keywords", "|").alias("keywords")
    )


def keyword_visual(spark, d):
    kw = t.paper_keywords(spark, d)
    nodes, _ = keywords.visual_subgraph(kw, keywords.cooccurrence_edges(kw), 50)
    return _round(nodes, "degree_centrality")


def author_collaboration(spark, d):
    return authors.collaboration_edges(t.authorship(spark, d))


def author_collaboration_active(spark, d):
    return authors.collaboration_edges(t.authorship(spark, d), min_collaborations=3, min_papers=5)


def author_common_papers(spark, d):
    return authors.common_papers(t.authorship(spark, d)).select(
        "author1", "author2", F.array_join(F.col("common_papers").cast("array<string>"), ",").alias("common_papers")
    )


def author_stats(spark, d):
    return authors.author_statistics(t.authorship(spark, d), t.papers(spark, d))


def author_productivity(spark, d):
    return _round(authors.author_profiles(t.authorship(spark, d), t.papers(spark, d)), "avg_co_authors")


def author_top_keywords(spark, d):
    return authors.author_keywords(t.authorship(spark, d), t.paper_keywords(spark, d), 10)


def author_paper_edges(spark, d):
    return authors.authored_edges(t.authorship(spark, d))


def paper_stats(spark, d):
    return authors.paper_statistics(t.authorship(spark, d))


def activity_filter(spark, d):
    return authors.filter_by_activity(t.authorship(spark, d), 5, 3).select("paper_id", "author_id", "author_count")


def team_types(spark, d):
    return authors.team_types(t.authorship(spark, d))


def authorship_patterns(spark, d):
    return authors.authorship_patterns(t.authorship(spark, d))


def productivity_types(spark, d):
    return authors.productivity_types(authors.author_profiles(t.authorship(spark, d), t.papers(spark, d)))


def authors_per_year(spark, d):
    return authors.activity_by_year(t.authorship(spark, d), t.papers(spark, d))


def interdisciplinary(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.split("text", r"[ .,\n]+").alias("w"))
    named = F.transform("w", lambda x: F.when(x == "the", "AI").when(x == "of", "Power").when(x == "in", "Design").otherwise(x))
    return docs.select("doc_id", authors.is_interdisciplinary(named).alias("is_interdisciplinary"))


def journal_stats(spark, d):
    return _round(
        journals.journal_statistics(t.papers(spark, d), t.authorship(spark, d), t.paper_keywords(spark, d)), "avg_authors_per_paper"
    )


def journal_types(spark, d):
    """Nation names carry no journal words, so the parts' brand and type give the class a name to work on."""
    named = t.table(spark, d, "part").select(
        F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in JOURNAL_WORDS]), (F.col("p_size") % 8 + 1).cast("int")), "p_brand", "p_type").alias("journal")
    )
    return journals.journal_types(named)


JOURNAL_WORDS = ["IEEE", "Nature", "Energy", "Neural", "Computing", "Industrial", "Applied", "Acta"]


def journal_keywords(spark, d):
    return journals.journal_keywords(t.papers(spark, d), t.paper_keywords(spark, d), 10)


def journal_papers(spark, d):
    return journals.published_in_edges(journals.journal_papers(t.papers(spark, d)), 2).select("paper_id", "journal", "year")


def journals_per_year(spark, d):
    return journals.journals_by_year(t.papers(spark, d))


def citation_edges(spark, d):
    return citation_graph(spark, d)[0].select("citing_id", "cited_id")


def citation_degree(spark, d):
    return citations.citation_degrees(*citation_graph(spark, d))


def citation_lag(spark, d):
    return _round(citations.citation_lag(*citation_graph(spark, d)), "avg_lag")


def citation_summary(spark, d):
    return _round(citations.citation_summary(*citation_graph(spark, d)), "mean_citations")


def citations_per_year(spark, d):
    return citations.citations_by_year(*citation_graph(spark, d))


def collaboration_graph(spark, d, minimum=1):
    edges = authors.collaboration_edges(t.authorship(spark, d), min_collaborations=minimum)
    edges = edges.select(F.col("author1").alias("src"), F.col("author2").alias("dst"), F.col("collaboration_count").alias("weight"))
    return t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), edges


def graph_density(spark, d):
    nodes, edges = collaboration_graph(spark, d)
    return _round(graph_stats.density(nodes, edges, directed=False), "density")


def degree_centrality_top(spark, d):
    nodes, edges = collaboration_graph(spark, d)
    scored = graph_stats.top_by(graph_stats.degrees(nodes, edges).select("id", "degree", "degree_centrality"), "degree_centrality", 10)
    return _round(scored, "degree_centrality")


def degree_summary(spark, d):
    nodes, edges = collaboration_graph(spark, d)
    out = graph_stats.degree_summary(nodes, edges)
    return _round(out.select("avg_degree", "max_degree", "min_degree"), "avg_degree")


def edge_enriched(spark, d):
    nodes = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    _, edges = collaboration_graph(spark, d, 2)
    return graph_stats.enrich_edges(edges, nodes, ["name", "nation"])


def author_info_map(spark, d):
    profiles = authors.author_profiles(t.authorship(spark, d), t.papers(spark, d))
    top3 = authors.author_keywords(t.authorship(spark, d), t.paper_keywords(spark, d), 3)
    listed = top3.groupBy("author_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]), ", ").alias("top_keywords")
    )
    return profiles.select("author_id", "paper_count", "productivity_type", "most_frequent_journal").join(listed, "author_id", "left")


def collaboration_strength(spark, d):
    _, edges = collaboration_graph(spark, d)
    return _round(distribution(edges, "weight", [0.5, 0.75, 0.9]), "value")


QUERIES = {
    f.__name__: f
    for f in (
        keyword_cooccurrence, keyword_frequency_topn, keyword_filter, keyword_table, keyword_visual,
        author_collaboration, author_collaboration_active, author_common_papers, author_stats, author_productivity,
        author_top_keywords, author_paper_edges, paper_stats, activity_filter, team_types, authorship_patterns,
        productivity_types, authors_per_year, interdisciplinary, journal_stats, journal_types, journal_keywords,
        journal_papers, journals_per_year, citation_edges, citation_degree, citation_lag, citation_summary,
        citations_per_year, graph_density, degree_centrality_top, degree_summary, edge_enriched, author_info_map,
        collaboration_strength,
    )
}

COOC = """f AS (SELECT keyword, count(*) AS freq FROM kw GROUP BY keyword HAVING count(*) >= 2),
k AS (SELECT kw.* FROM kw JOIN f USING (keyword)),
cooc AS (SELECT a.keyword AS keyword1, b.keyword AS keyword2, count(*) AS weight
         FROM k a JOIN k b ON a.paper_id = b.paper_id AND a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 2)"""
TEAM = "CASE WHEN n = 1 THEN 'Single Author' WHEN n <= 3 THEN 'Small Team' WHEN n <= 6 THEN 'Medium Team' ELSE 'Large Team' END"
MAIN = """mj AS (SELECT author_id, journal AS most_frequent_journal, count(*) OVER (PARTITION BY author_id) AS unique_journals,
       row_number() OVER (PARTITION BY author_id ORDER BY c DESC, seen) AS rn
  FROM (SELECT author_id, journal, count(*) AS c, min(paper_id) AS seen FROM auth JOIN papers USING (paper_id) GROUP BY 1, 2))"""
PROFILE = """base AS (SELECT author_id, count(*) AS paper_count, count(*) FILTER (pos = 0) AS first_author_count,
       count(*) FILTER (pos = n - 1) AS last_author_count, count(*) FILTER (n = 1) AS single_author_count,
       min(year) AS first_year, max(year) AS last_year, avg(n - 1) AS avg_co_authors
  FROM flags JOIN papers USING (paper_id) GROUP BY 1),
yearly AS (SELECT author_id, string_agg(year || ':' || c, ';' ORDER BY year) AS papers_by_year
  FROM (SELECT author_id, year, count(*) AS c FROM auth JOIN papers USING (paper_id) GROUP BY 1, 2) GROUP BY 1),
profile AS (SELECT base.*, papers_by_year, unique_journals, most_frequent_journal, last_year - first_year + 1 AS active_years,
       CASE WHEN paper_count >= 10 AND last_year - first_year + 1 >= 5 THEN 'Highly Productive'
            WHEN paper_count >= 5 AND first_author_count >= 2 THEN 'Leading Researcher'
            WHEN paper_count >= 3 THEN 'Active Researcher' WHEN paper_count = 1 THEN 'Newcomer'
            ELSE 'Occasional Contributor' END AS productivity_type
  FROM base JOIN yearly USING (author_id) JOIN mj USING (author_id) WHERE rn = 1)"""
STOP = ", ".join(f"'{w}'" for w in __import__("scholarweave.fixed_values", fromlist=["x"]).KEYWORD_STOPWORDS)
CDATED = """cy AS (SELECT p.year AS citing_year, q.year AS cited_year FROM cites JOIN papers p ON citing_id = p.paper_id JOIN papers q ON cited_id = q.paper_id)"""
TYPE_CASE = """CASE WHEN j LIKE '%ieee%' THEN 'IEEE' WHEN j LIKE '%nature%' OR j LIKE '%science%' THEN 'High-Impact'
 WHEN j LIKE '%energy%' OR j LIKE '%power%' OR j LIKE '%electric%' THEN 'Energy & Power'
 WHEN j LIKE '%neural%' OR j LIKE '%machine%' OR j LIKE '%artificial%' OR j LIKE '%intelligence%' THEN 'AI & ML'
 WHEN j LIKE '%computer%' OR j LIKE '%computing%' OR j LIKE '%software%' THEN 'Computer Science'
 WHEN j LIKE '%engineering%' OR j LIKE '%industrial%' OR j LIKE '%automation%' THEN 'Engineering'
 WHEN j LIKE '%applied%' OR j LIKE '%international%' OR j LIKE '%journal%' THEN 'Applied Science' ELSE 'Other' END"""
DEG = """deg AS (SELECT s_suppkey AS id, coalesce(c, 0) AS degree FROM supplier LEFT JOIN
  (SELECT a, count(*) AS c FROM (SELECT author1 AS a FROM collab UNION ALL SELECT author2 FROM collab) GROUP BY a) ON a = s_suppkey)"""

SQL = {
    "keyword_cooccurrence": with_views(KW, COOC) + """
SELECT keyword1, keyword2, weight, round(CAST(weight AS DOUBLE) / (f1.freq + f2.freq - weight), 6) AS jaccard_similarity,
       round(CAST(weight AS DOUBLE) / greatest(f1.freq, f2.freq), 6) AS normalized_weight
FROM cooc JOIN f f1 ON f1.keyword = keyword1 JOIN f f2 ON f2.keyword = keyword2""",
    "keyword_frequency_topn": with_views(KW) + """
SELECT keyword, count(*) AS freq FROM kw GROUP BY keyword
ORDER BY freq DESC, min(paper_id), min_by(line, paper_id), keyword LIMIT 20""",
    "keyword_filter": with_views(KW) + """, f AS (SELECT keyword, count(*) AS freq FROM kw GROUP BY 1)
SELECT paper_id, count(*) AS filtered_keyword_count FROM kw JOIN f USING (keyword)
WHERE freq >= (SELECT floor(avg(freq)) FROM f) GROUP BY 1""",
    "keyword_table": f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS k, generate_subscripts(string_split(text, ' '), 1) AS i,
  len(string_split(text, ' ')) AS n FROM documents),
c AS (SELECT doc_id, i, n, lower(regexp_replace(k, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g')) AS k FROM w),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM c
  WHERE length(k) BETWEEN 2 AND 50 AND NOT regexp_matches(k, '^\\p{{Nd}}+$') AND regexp_matches(k, '[a-zA-Z0-9]') AND k NOT IN ({STOP}))
SELECT doc_id AS paper_id, CAST(any_value(n) AS INTEGER) AS original_keyword_count, CAST(count(*) AS INTEGER) AS clean_keyword_count,
       string_agg(k, '|' ORDER BY rn) AS keywords FROM g GROUP BY 1""",
    "keyword_visual": with_views(KW, COOC) + """, top AS (SELECT keyword, count(*) AS freq FROM kw GROUP BY keyword
  ORDER BY freq DESC, min(paper_id), min_by(line, paper_id), keyword LIMIT 50),
e AS (SELECT * FROM cooc WHERE keyword1 IN (SELECT keyword FROM top) AND keyword2 IN (SELECT keyword FROM top)),
dg AS (SELECT k, count(*) AS c FROM (SELECT keyword1 AS k FROM e UNION ALL SELECT keyword2 FROM e) GROUP BY k)
SELECT keyword, freq, coalesce(c, 0) AS degree, round(coalesce(c, 0) / ((SELECT count(*) FROM top) - 1), 6) AS degree_centrality
FROM top LEFT JOIN dg ON k = keyword""",
    "author_collaboration": with_views(AUTH, COLLAB) + " SELECT * FROM collab",
    "author_collaboration_active": with_views(AUTH, COLLAB) + """, act AS (SELECT author_id FROM auth GROUP BY 1 HAVING count(*) >= 5)
SELECT * FROM collab WHERE collaboration_count >= 3 AND author1 IN (SELECT * FROM act) AND author2 IN (SELECT * FROM act)""",
    "author_common_papers": with_views(AUTH) + """, p AS (SELECT a.author_id AS author1, b.author_id AS author2, a.paper_id,
  row_number() OVER (PARTITION BY a.author_id, b.author_id ORDER BY a.paper_id) AS rn
  FROM auth a JOIN auth b ON a.paper_id = b.paper_id AND a.author_id < b.author_id)
SELECT author1, author2, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY rn) AS common_papers FROM p WHERE rn <= 5 GROUP BY 1, 2""",
    "author_stats": with_views(PAPERS, AUTH, COLLAB, MAIN) + """,
span AS (SELECT author_id, count(*) AS paper_count, min(year) AS first_year, max(year) AS last_year FROM auth JOIN papers USING (paper_id) GROUP BY 1),
par AS (SELECT a AS author_id, count(*) AS c FROM (SELECT author1 AS a FROM collab UNION ALL SELECT author2 FROM collab) GROUP BY 1)
SELECT author_id, paper_count, coalesce(c, 0) AS collaborator_count, first_year, last_year, last_year - first_year + 1 AS active_years,
       unique_journals, most_frequent_journal
FROM span LEFT JOIN par USING (author_id) JOIN mj USING (author_id) WHERE rn = 1""",
    "author_productivity": with_views(PAPERS, AUTH, FLAGS, MAIN, PROFILE) + """
SELECT author_id, paper_count, first_author_count, last_author_count, single_author_count, first_year, last_year,
       round(avg_co_authors, 6) AS avg_co_authors, papers_by_year, unique_journals, most_frequent_journal, active_years, productivity_type
FROM profile""",
    "author_top_keywords": with_views(AUTH, KW) + """, c AS (SELECT author_id, keyword, count(*) AS freq FROM auth JOIN kw USING (paper_id) GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY author_id ORDER BY freq DESC, keyword) AS INTEGER) AS rank FROM c) WHERE rank <= 10""",
    "author_paper_edges": with_views(AUTH, FLAGS) + """
SELECT author_id, paper_id, pos AS authorship_position, pos = 0 AS is_first_author, pos = n - 1 AS is_last_author, n - 1 AS co_author_count FROM flags""",
    "paper_stats": with_views(AUTH) + f""", e AS (SELECT author_id, count(*) AS p FROM auth GROUP BY 1),
s AS (SELECT paper_id, count(*) AS n, count(*) FILTER (p = 1) AS novice, count(*) FILTER (p > 1 AND p <= 5) AS intermediate,
       count(*) FILTER (p > 5) AS experienced FROM auth JOIN e USING (author_id) GROUP BY 1)
SELECT paper_id, n AS author_count, novice, intermediate, experienced, {TEAM} AS collaboration_type, experienced > 0 AS has_experienced_authors FROM s""",
    "activity_filter": with_views(AUTH) + """, k AS (SELECT * FROM auth WHERE author_id IN (SELECT author_id FROM auth GROUP BY 1 HAVING count(*) >= 5))
SELECT paper_id, author_id, author_count FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS author_count FROM k) WHERE author_count >= 3""",
    "team_types": with_views(AUTH) + f", s AS (SELECT paper_id, count(*) AS n FROM auth GROUP BY 1) SELECT {TEAM} AS collaboration_type, count(*) AS papers FROM s GROUP BY 1",
    "authorship_patterns": with_views(AUTH, FLAGS) + """
SELECT count(*) FILTER (pos = 0) AS first_author_papers, count(*) FILTER (pos = n - 1) AS last_author_papers, count(*) FILTER (n = 1) AS single_author_papers FROM flags""",
    "productivity_types": with_views(PAPERS, AUTH, FLAGS, MAIN, PROFILE) + """
SELECT productivity_type, count(*) AS authors, CAST(sum(paper_count) AS BIGINT) AS papers FROM profile GROUP BY 1""",
    "authors_per_year": with_views(PAPERS, AUTH) + """
SELECT year, count(*) AS authorships, count(DISTINCT paper_id) AS papers, count(DISTINCT author_id) AS authors FROM auth JOIN papers USING (paper_id) GROUP BY 1""",
    "interdisciplinary": r"""WITH w AS (SELECT doc_id, string_split_regex(text, '[ .,\n]+') AS w FROM documents)
SELECT doc_id, len(w) >= 3 AND (CAST(list_contains(w, 'the') OR list_contains(w, 'ai') AS INTEGER) + CAST(list_contains(w, 'of') AS INTEGER)
  + CAST(list_contains(w, 'in') OR list_contains(list_transform(w, lambda x: lower(x)), 'design') AS INTEGER)) >= 2 AS is_interdisciplinary FROM w""",
    "journal_stats": with_views(PAPERS, AUTH, KW) + f""", b AS (SELECT journal, count(*) AS paper_count, min(year) AS first_year, max(year) AS last_year FROM papers GROUP BY 1),
a AS (SELECT journal, count(DISTINCT author_id) AS unique_authors, count(*) AS au FROM auth JOIN papers USING (paper_id) GROUP BY 1),
k AS (SELECT journal, count(DISTINCT keyword) AS unique_keywords FROM kw JOIN papers USING (paper_id) GROUP BY 1)
SELECT journal, paper_count, unique_authors, unique_keywords, first_year, last_year, last_year - first_year + 1 AS active_years,
       round(au / paper_count, 6) AS avg_authors_per_paper, {TYPE_CASE.replace(' j ', ' lower(journal) ')} AS journal_type
FROM b JOIN a USING (journal) JOIN k USING (journal)""",
    "journal_types": "WITH n AS (SELECT lower(['IEEE', 'Nature', 'Energy', 'Neural', 'Computing', 'Industrial', 'Applied', 'Acta'][p_size % 8 + 1] || ' ' || p_brand || ' ' || p_type) AS j FROM part),"
    f" c AS (SELECT j, count(*) AS n FROM n GROUP BY 1) SELECT {TYPE_CASE} AS journal_type, count(*) AS journals, CAST(sum(n) AS BIGINT) AS papers FROM c GROUP BY 1",
    "journal_keywords": with_views(PAPERS, KW) + """, c AS (SELECT journal, keyword, count(*) AS freq FROM kw JOIN papers USING (paper_id) GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY journal ORDER BY freq DESC, keyword) AS INTEGER) AS rank FROM c) WHERE rank <= 10""",
    "journal_papers": with_views(PAPERS) + """
SELECT paper_id, journal, year FROM (SELECT *, count(*) OVER (PARTITION BY journal) AS n FROM papers) WHERE n >= 2""",
    "journals_per_year": with_views(PAPERS) + " SELECT year, count(*) AS papers, count(DISTINCT journal) AS journals FROM papers GROUP BY 1",
    "citation_edges": with_views(CITES) + " SELECT citing_id, cited_id FROM cites",
    "citation_degree": with_views(CITES) + """
SELECT o_orderkey AS paper_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM orders
LEFT JOIN (SELECT cited_id, count(*) AS i FROM cites GROUP BY 1) ON cited_id = o_orderkey
LEFT JOIN (SELECT citing_id, count(*) AS o FROM cites GROUP BY 1) ON citing_id = o_orderkey""",
    "citation_lag": with_views(PAPERS, CITES, CDATED) + """
SELECT count(*) AS lagged_citations, round(avg(citing_year - cited_year), 6) AS avg_lag, CAST(median(citing_year - cited_year) AS DOUBLE) AS median_lag
FROM cy WHERE citing_year > cited_year""",
    "citation_summary": with_views(CITES) + """, c AS (SELECT o_orderkey, count(citing_id) AS n FROM orders LEFT JOIN cites ON citing_id = o_orderkey GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_citations, count(*) FILTER (n > 0) AS papers_with_citations, round(avg(n), 6) AS mean_citations, max(n) AS max_citations FROM c""",
    "citations_per_year": with_views(PAPERS, CITES, CDATED) + " SELECT citing_year AS year, count(*) AS citations FROM cy GROUP BY 1",
    "graph_density": with_views(AUTH, COLLAB) + """
SELECT n AS num_nodes, m AS num_edges, round(2.0 * m / (n * (n - 1.0)), 6) AS density
FROM (SELECT count(*) AS n FROM supplier), (SELECT count(*) AS m FROM collab)""",
    "degree_centrality_top": with_views(AUTH, COLLAB, DEG) + """
SELECT id, degree, round(degree / ((SELECT count(*) FROM supplier) - 1), 6) AS degree_centrality FROM deg ORDER BY degree DESC, id LIMIT 10""",
    "degree_summary": with_views(AUTH, COLLAB, DEG) + " SELECT round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM deg",
    "edge_enriched": with_views(AUTH, COLLAB) + """
SELECT author1 AS src, author2 AS dst, collaboration_count AS weight, a.s_name AS src_name, a.s_nationkey AS src_nation, b.s_name AS dst_name, b.s_nationkey AS dst_nation
FROM collab LEFT JOIN supplier a ON author1 = a.s_suppkey LEFT JOIN supplier b ON author2 = b.s_suppkey WHERE collaboration_count >= 2""",
    "author_info_map": with_views(PAPERS, AUTH, FLAGS, MAIN, PROFILE, KW) + """,
c AS (SELECT author_id, keyword, count(*) AS freq FROM auth JOIN kw USING (paper_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY freq DESC, keyword) AS rn FROM c),
l AS (SELECT author_id, string_agg(keyword, ', ' ORDER BY rn) AS top_keywords FROM r WHERE rn <= 3 GROUP BY 1)
SELECT author_id, paper_count, productivity_type, most_frequent_journal, top_keywords FROM profile LEFT JOIN l USING (author_id)""",
    "collaboration_strength": with_views(AUTH, COLLAB) + """
SELECT unnest(['count', 'mean', 'std', 'min', 'max', 'p50', 'p75', 'p90']) AS metric,
       unnest([CAST(n AS DOUBLE), round(mean, 6), round(sd, 6), mn, mx, round(p50, 6), round(p75, 6), round(p90, 6)]) AS value
FROM (SELECT count(*) AS n, avg(collaboration_count) AS mean, stddev_pop(collaboration_count) AS sd, CAST(min(collaboration_count) AS DOUBLE) AS mn,
  CAST(max(collaboration_count) AS DOUBLE) AS mx, quantile_cont(collaboration_count, 0.5) AS p50, quantile_cont(collaboration_count, 0.75) AS p75,
  quantile_cont(collaboration_count, 0.9) AS p90 FROM collab)""",
}
