"""SQL text of the domain views, shared by the checking statements."""

PAPERS = """papers AS (
  SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS journal,
         'Study ' || c_mktsegment || ' ' || o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS title
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
AUTH = """auth AS (
  SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)"""
KW = """kw AS (
  SELECT l_orderkey AS paper_id, p_name AS keyword, min(l_linenumber) AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
CITES = """cites AS (
  SELECT * FROM (SELECT o_orderkey AS citing_id,
                        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cited_id
                 FROM orders) WHERE cited_id IS NOT NULL)"""
FLAGS = """flags AS (
  SELECT paper_id, author_id, row_number() OVER (PARTITION BY paper_id ORDER BY line, author_id) - 1 AS pos,
         count(*) OVER (PARTITION BY paper_id) AS n FROM auth)"""
COLLAB = """collab AS (
  SELECT a.author_id AS author1, b.author_id AS author2, count(*) AS collaboration_count
  FROM auth a JOIN auth b ON a.paper_id = b.paper_id AND a.author_id < b.author_id GROUP BY 1, 2)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views)
