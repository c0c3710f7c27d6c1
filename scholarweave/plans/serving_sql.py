"""Checking SQL of the serving area, written from the same fixed values."""

from __future__ import annotations

from scholarweave import question_patterns as qp
from scholarweave.fixed_values import EDGE_IMPORTANCE
from scholarweave.plans.graph import LIT, LOCAL, REL
from scholarweave.plans.ingest import S, quoted, words_sql

OPEN_LIST = """['Who is the most cited author in 2019 after John Smith wrote about ', 'Compare research trend and change between 2015 and 2020 for battery papers: ',
 '최근 배터리 연구 동향은 무엇인가 machine learning 논문 분석 ', '김철수 교수의 SoC 연구 ', 'List papers by Dr. Mary Jones and J. Miller in the Journal of Power about ',
 'Give a comprehensive overall network analysis of hidden patterns: ', '']"""


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def count(column, patterns, flags=""):
    return "(" + " + ".join(f"len(regexp_extract_all({column}, {lit(flags + p)}))" for p in patterns) + ")"


def hits(column, patterns):
    return "(" + " + ".join(f"CAST(regexp_matches({column}, {lit(p)}) AS INTEGER)" for p in patterns) + ")"


def terms(column, values):
    return "(" + " + ".join(f"CAST(contains(lower({column}), {lit(v.lower())}) AS INTEGER)" for v in values) + ")"


def every(column, patterns):
    return "flatten([" + ", ".join(f"regexp_extract_all({column}, {lit(p)}, 1)" for p in patterns) + "])"


def distinct(values):
    return f"list_sort(list_distinct(list_filter(list_transform({values}, lambda v: trim(v)), lambda v: v <> '')))"


def domain_words(column):
    return f"list_filter([{quoted(qp.DOMAIN_WORDS)}], lambda k: contains(lower({column}), lower(k)))"


NO = "CAST([] AS VARCHAR[])"
ASCII = lambda c: f"regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"

ko, en = "len(regexp_extract_all(question, '[가-힣]'))", "len(regexp_extract_all(question, '[a-zA-Z]'))"
ASKED = f"""q0 AS (SELECT conv_id, turn, {OPEN_LIST}[(conv_id + turn) % 7 + 1] || text AS question FROM conversations WHERE role = 'user'),
q1 AS (SELECT *, {ko} AS ko, {en} AS en, {count('question', qp.LANGUAGE_MARKS['ko'])} AS mk, {count(ASCII('question'), qp.LANGUAGE_MARKS['en'])} AS me,
  {terms('question', qp.TECHNICAL_WORDS)} AS te, {terms('question', qp.ACADEMIC_WORDS_KO)} AS tk FROM q0),
q2 AS (SELECT *, ko / greatest(ko + en, 1) AS r FROM q1),
q AS MATERIALIZED (SELECT conv_id, turn, question, CASE WHEN ko + en = 0 THEN 'ko'
    WHEN r > 0.1 AND r < 0.9 AND te > 0 AND tk > 0 THEN CASE WHEN mk > me THEN 'ko' WHEN me > mk THEN 'en' WHEN r >= 0.5 THEN 'ko' ELSE 'en' END
    WHEN r > 0.7 THEN 'ko' WHEN r < 0.3 THEN 'en' WHEN mk + tk > me + te THEN 'ko' WHEN me + te > mk + tk THEN 'en' WHEN r >= 0.5 THEN 'ko' ELSE 'en' END AS language,
  regexp_replace(regexp_replace(regexp_replace(question, '^{S}+|{S}+$', '', 'g'), '{S}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s?!.,()\\-]', ' ', 'g') AS processed FROM q2)"""
ENT = f"""e0 AS (SELECT *, {ASCII('processed')} AS pa, regexp_matches(processed, '[가-힣]') AND regexp_matches(processed, '[a-zA-Z]') AS mixed FROM q),
ent AS MATERIALIZED (SELECT *, {distinct(f"list_concat(list_concat(CASE WHEN language = 'ko' OR mixed THEN {every('processed', qp.AUTHOR_PATTERNS['ko'])} ELSE {NO} END, CASE WHEN language = 'en' OR mixed THEN {every('processed', qp.AUTHOR_PATTERNS['en'])} ELSE {NO} END), CASE WHEN mixed THEN {every('processed', qp.AUTHOR_PATTERNS['mixed'])} ELSE {NO} END)")} AS authors,
  {distinct(every('processed', qp.JOURNAL_PATTERNS))} AS journals, {distinct(every('processed', qp.INSTITUTION_PATTERNS))} AS institutions,
  {distinct(every('pa', [qp.YEAR_PATTERN]))} AS years,
  {distinct(f"list_transform(list_concat({domain_words('processed')}, list_concat({every('pa', qp.TECHNICAL_PATTERNS[:4])}, {every('processed', qp.TECHNICAL_PATTERNS[4:])})), lambda x: lower(x))")} AS keywords FROM e0)"""


def level(lang):
    return "greatest(" + ", ".join(f"CASE WHEN regexp_matches(processed, {lit('(?i)' + '|'.join(t))}) THEN {qp.LEVEL_WEIGHTS[n]} ELSE 0 END" for n, t in qp.LEVEL_TERMS[lang].items()) + ")"


def both(lang, other, f):
    return f"{f(lang)}, CASE WHEN mixed THEN {f(other)} ELSE 0 END"


WORDS = lambda lang: count("processed", qp.QUESTION_WORDS[lang], "(?i)")
COMPLEX = f"""c0 AS (SELECT *, CASE WHEN language = 'ko' THEN {WORDS('ko')} + CASE WHEN mixed THEN {WORDS('en')} ELSE 0 END ELSE {WORDS('en')} + CASE WHEN mixed THEN {WORDS('ko')} ELSE 0 END END AS qw,
  CASE WHEN language = 'ko' THEN greatest({both('ko', 'en', level)}) ELSE greatest({both('en', 'ko', level)}) END AS lv,
  CASE WHEN regexp_matches(processed, {lit('(?i)' + '|'.join(qp.ADVANCED_TERMS))}) THEN 0.7 ELSE 0 END AS adv,
  len(authors) + len(journals) + len(institutions) + len(years) + len(keywords) AS ne,
  CAST(len(authors) > 0 AS INTEGER) + CAST(len(journals) > 0 AS INTEGER) + CAST(len(institutions) > 0 AS INTEGER) + CAST(len(years) > 0 AS INTEGER) + CAST(len(keywords) > 0 AS INTEGER) AS nk,
  {count('processed', qp.LOGICAL_PATTERNS[:4])} + {count('pa', qp.LOGICAL_PATTERNS[4:])} AS lo, {count('processed', qp.TEMPORAL_PATTERNS[:6])} + {count('pa', qp.TEMPORAL_PATTERNS[6:])} AS tm,
  CASE WHEN mixed THEN 0.1 ELSE 0.0 END AS b FROM ent),
c1 AS (SELECT *, least(1.0, least(1.0, least(1.0, len({words_sql('processed')}) / 20) + b) * 0.1 + least(1.0, least(1.0, qw / 3) + b) * 0.15 + least(1.0, greatest(lv, adv) + b) * 0.25
  + least(1.0, CASE WHEN nk >= 3 THEN least(1.0, least(1.0, ne / 10) * 1.3) ELSE least(1.0, ne / 10) END + b) * 0.2 + least(1.0, least(1.0, lo / 3) + b) * 0.15
  + least(1.0, CASE WHEN tm > 0 THEN least(1.0, 0.4 + tm * 0.2) ELSE 0.0 END + b) * 0.15)::DOUBLE AS score FROM c0),
cx AS MATERIALIZED (SELECT *, CASE WHEN round(score, 12) <= 0.3 THEN 'simple' WHEN round(score, 12) <= 0.6 THEN 'medium' WHEN round(score, 12) <= 0.8 THEN 'complex' ELSE 'exploratory' END AS complexity FROM c1)"""
KINDS = list(qp.TYPE_TERMS["en"])
EXTRA = {"author_analysis": " + CASE WHEN len(authors) > 0 THEN 2 ELSE 0 END", "keyword_analysis": " + CASE WHEN len(keywords) > 0 THEN 2 ELSE 0 END", "trend_analysis": " + CASE WHEN len(years) > 0 THEN 1 ELSE 0 END"}
TYPES = "t0 AS (SELECT *, [" + ", ".join(
    f"CASE WHEN language = 'ko' THEN {hits('lower(processed)', qp.TYPE_TERMS['ko'][k])} ELSE {hits('lower(processed)', qp.TYPE_TERMS['en'][k])} END{EXTRA.get(k, '')}" for k in KINDS
) + f", {hits('lower(processed)', qp.COMPREHENSIVE_TERMS)} * 3] AS sc FROM cx),\nty AS MATERIALIZED (SELECT *, CASE WHEN list_max(sc) = 0 THEN 'factual_lookup' ELSE [{quoted([*KINDS, 'comprehensive_analysis'])}][list_position(sc, list_max(sc))] END AS query_type FROM t0)"


def resources(at, default):
    return "CASE query_type " + " ".join(f"WHEN {lit(k)} THEN [{quoted(v[at])}]" for k, v in qp.RESOURCES.items()) + f" ELSE [{quoted(default)}] END"


def plus(test, values):
    return f"CASE WHEN {test} THEN [{quoted(values)}] ELSE {NO} END"


A_, K_, Y_ = "len(authors) > 0", "len(keywords) > 0", "len(years) > 0"
PLAN = f"""pl AS (SELECT *, CASE WHEN len(authors) >= 2 THEN 'local' WHEN complexity = 'exploratory' OR query_type = 'comprehensive_analysis' THEN 'global'
   WHEN query_type IN ('trend_analysis', 'collaboration_analysis') THEN 'hybrid' WHEN len(authors) > 0 THEN 'local' ELSE 'global' END AS search_mode,
  list_sort(list_distinct(list_concat({resources(0, ['paper'])}, list_concat({plus(A_, ['author'])}, {plus(K_, ['keyword'])})))) AS rn,
  list_sort(list_distinct(list_concat(list_concat({resources(1, ['cites'])}, {plus(A_, ['authored_by', 'collaborates_with'])}), list_concat({plus(K_, ['has_keyword', 'co_occurs_with'])}, {plus(Y_, ['temporal_proximity'])})))) AS re FROM ty)"""
HINTS = """list_filter([CASE WHEN complexity = 'simple' THEN 'Direct entity lookup recommended' END, CASE WHEN complexity = 'exploratory' THEN 'Consider community detection algorithms' END,
 CASE WHEN complexity = 'exploratory' THEN 'Enable broad graph traversal' END, CASE WHEN query_type = 'trend_analysis' THEN 'Include temporal analysis' END,
 CASE WHEN query_type = 'trend_analysis' THEN 'Consider time-series aggregation' END, CASE WHEN query_type = 'collaboration_analysis' THEN 'Focus on author-author relationships' END,
 CASE WHEN query_type = 'collaboration_analysis' THEN 'Calculate network centrality metrics' END, CASE WHEN list_contains(rn, 'author') THEN 'Include author disambiguation' END,
 CASE WHEN len(rn) > 2 THEN 'Use multi-type graph traversal' END], lambda h: h IS NOT NULL)"""
TURNS = """said AS (SELECT *, coalesce(first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ai FROM conversations),
turns AS (SELECT 's-' || (h.conv_id % 7) AS session_id, h.conv_id * 100 + h.turn AS turn, 1704067200 + h.conv_id * 3600 + h.turn * 60 AS tsec,
   length(h.text || h.ai) // 4 AS tokens, (length(h.text) % 100) / 100.0::DOUBLE AS relevance, string_split(h.text, ' ')[1:4] AS keywords
  FROM said h WHERE h.role = 'user')"""
LABELS = """lab AS (SELECT 'paper_' || o_orderkey AS id, 'paper' AS ty, 'Study ' || c_mktsegment || ' ' || o_orderpriority || ' ' || o_orderkey AS label FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'author_' || s_suppkey, 'author', s_name FROM supplier UNION ALL SELECT n_name, 'journal', n_name FROM nation
  UNION ALL SELECT DISTINCT p_name, 'keyword', p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def encoded(name, rows):
    """(id, v) of the hashing encoder for ``rows`` (id, label)."""
    return f"""{name}_t AS (SELECT id, unnest(list_filter(string_split_regex(lower(label), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w FROM {rows}),
{name}_h AS (SELECT id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS pos, CASE WHEN CAST('0x' || substr(md5(w), 8, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM {name}_t),
{name}_b AS (SELECT id, pos, CAST(sum(s) AS DOUBLE) AS x FROM {name}_h GROUP BY 1, 2),
{name}_n AS (SELECT id, pos, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS x FROM {name}_b QUALIFY sum(x * x) OVER (PARTITION BY id) > 0),
{name} AS MATERIALIZED (SELECT id, list(coalesce(x, 0.0) ORDER BY pos) AS v FROM (SELECT id, pos, sum(x) AS x FROM (SELECT id, pos, x FROM {name}_n UNION ALL SELECT id, p, 0.0 FROM (SELECT DISTINCT id FROM {name}_n), range(64) r(p)) GROUP BY 1, 2) GROUP BY 1)"""


def kept(score, views=""):
    return f"""WITH {TURNS}{views}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {score}) AS rk, count(*) OVER (PARTITION BY session_id) AS n FROM turns)
SELECT session_id, turn FROM r WHERE rk <= greatest(3, floor(n * 0.3))"""


NOW = 1704844800
PRIO = f"""{LOCAL}, {REL}, pr AS (SELECT rel.query_id, rel.node_id, relevance, round(relevance + CASE WHEN sim IS NOT NULL THEN 0.3 ELSE 0 END
   + CASE WHEN rel.node_id LIKE 'paper_%' THEN 0.2 + 0.15 WHEN rel.node_id LIKE 'author_%' THEN 0.15 ELSE 0.05 END + CASE WHEN doc_id IS NOT NULL THEN 0.1 ELSE 0 END, 9) AS s
  FROM rel LEFT JOIN seeds ON seeds.query_id = rel.query_id AND seeds.node_id = rel.node_id
  LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 100) d ON 'paper_' || doc_id = rel.node_id)"""
IMPORTANCE = "CASE edge_type " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in EDGE_IMPORTANCE.items()) + " ELSE 0.05 END"
INDUCED = """i AS (SELECT x.query_id, src, dst, edge_type, row_number() OVER (PARTITION BY x.query_id ORDER BY src, dst, edge_type) AS rn
  FROM lit JOIN m3 x ON x.node_id = src JOIN m3 y ON y.node_id = dst AND y.query_id = x.query_id)"""
CHARS = "list_filter(string_split(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'), ''), lambda c: c <> '')"
MEANINGLESS = f"""(length(t) < 15 OR coalesce(list_max(list_transform(list_distinct({CHARS}), lambda c: len(list_filter({CHARS}, lambda d: d = c)))) > len({CHARS}) * 0.5, false)
  OR (len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) < 5 AND len(regexp_extract_all(t, '[가-힣]+')) < 2 AND len(regexp_extract_all(t, '[a-zA-Z]+')) < 3)
  OR regexp_matches(t, '^[^\\p{{L}}\\p{{N}}\\s~`\\x{{80}}-\\x{{10FFFF}}]+$') OR regexp_matches(t, '^[0-9\\s]+$'))"""

SQL = {
    "query_language": f"WITH {ASKED} SELECT conv_id, turn, language, processed FROM q",
    "query_entities": f"WITH {ASKED}, {ENT} SELECT conv_id, turn, array_to_string(authors, '|') AS authors, array_to_string(journals, '|') AS journals, array_to_string(institutions, '|') AS institutions, array_to_string(years, '|') AS years, array_to_string(keywords, '|') AS keywords FROM ent",
    "query_complexity": f"WITH {ASKED}, {ENT}, {COMPLEX} SELECT conv_id, turn, round(score, 6) AS complexity_score, complexity, CAST(CASE complexity WHEN 'simple' THEN 10 WHEN 'medium' THEN 30 WHEN 'complex' THEN 120 ELSE 300 END AS INTEGER) AS suggested_timeout FROM cx",
    "query_type": f"WITH {ASKED}, {ENT}, {COMPLEX}, {TYPES} SELECT conv_id, turn, query_type FROM ty",
    "query_plan": f"""WITH {ASKED}, {ENT}, {COMPLEX}, {TYPES}, {PLAN}
SELECT conv_id, turn, search_mode, CASE WHEN len(authors) > 3 THEN 'narrow' WHEN complexity IN ('complex', 'exploratory') THEN 'broad' ELSE 'medium' END AS estimated_scope,
  CASE WHEN complexity = 'simple' THEN 'local' WHEN complexity = 'exploratory' THEN 'global' WHEN query_type = 'citation_analysis' THEN 'local' WHEN query_type = 'collaboration_analysis' THEN 'community'
    WHEN query_type = 'trend_analysis' THEN 'temporal' WHEN query_type = 'comprehensive_analysis' THEN 'global' WHEN search_mode IN ('local', 'global') THEN search_mode ELSE 'hybrid' END AS strategy,
  round(least(1.0, 0.5 + score * 0.5), 6)::DOUBLE AS confidence, array_to_string(rn, '|') AS required_node_types, array_to_string(re, '|') AS required_edge_types,
  array_to_string({HINTS}, '|') AS processing_hints,
  array_to_string(list_concat(years, list_filter([{quoted(qp.TIME_WORDS)}], lambda w: contains(lower(processed), w))), '|') AS temporal_indicators FROM pl""",
    "question_seeds": f"""WITH {ASKED}, {ENT}, {COMPLEX}, {TYPES}, {PLAN}, {LABELS}, qs AS (SELECT conv_id || '-' || turn AS id, question AS label, rn FROM pl),
{encoded('qe', 'qs')}, {encoded('ne', 'lab')},
s AS (SELECT qs.id AS query_id, lab.id AS node_id, list_cosine_similarity(qe.v, ne.v) AS sim FROM qs JOIN qe ON qe.id = qs.id JOIN lab ON list_contains(qs.rn, lab.ty) OR len(qs.rn) = 0 JOIN ne ON ne.id = lab.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, node_id) AS rk FROM s WHERE sim >= 0.2)
SELECT query_id, node_id, round(sim, 5) AS similarity, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5""",
    "embedding_updates": """WITH n AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(DISTINCT p_name) FROM lineitem JOIN part ON l_partkey = p_partkey) AS j),
p AS (SELECT count(*) AS p, count(*) FILTER (o_orderkey % 7 = 0) AS gone, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 10 = 0) AS changed FROM orders)
SELECT 1::INTEGER AS run, p + j AS encoded, 0::BIGINT AS kept, 0::BIGINT AS removed, p + j - gone AS stored_at_end FROM n, p
UNION ALL SELECT 2, changed, p + j - gone - changed, gone, p + j - gone FROM n, p UNION ALL SELECT 3, 0, p + j - gone, 0, p + j - gone FROM n, p""",
    "context_totals": f"""{PRIO}, {INDUCED}, np AS (SELECT query_id, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS p FROM pr),
n AS (SELECT query_id, count(*) AS included_nodes, count(*) FILTER (p = 'critical') AS critical, count(*) FILTER (p = 'high') AS high, count(*) FILTER (p = 'medium') AS medium, count(*) FILTER (p = 'low') AS low FROM np GROUP BY 1),
x AS (SELECT query_id, count(*) AS included_edges FROM i WHERE rn <= 500 GROUP BY 1)
SELECT n.*, coalesce(included_edges, 0) AS included_edges FROM n LEFT JOIN x USING (query_id)""",
    "store_metadata": f"""WITH {LABELS}, l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS n FROM lineitem),
a AS (SELECT 'paper_' || o AS id, count(*) AS c, min_by(s_name, (n, s_name)) AS f FROM l JOIN supplier ON s = s_suppkey GROUP BY 1),
k AS (SELECT 'paper_' || l_orderkey AS id, count(DISTINCT p_name) AS c, min_by(p_name, (l_linenumber, p_name)) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT lab.id, lab.ty AS node_type, CAST(a.c AS INTEGER) AS authors_count, a.f AS authors_first, CAST(k.c AS INTEGER) AS keywords_count, k.f AS keywords_first FROM lab LEFT JOIN a ON a.id = lab.id LEFT JOIN k ON k.id = lab.id WHERE lab.ty = 'paper'""",
    "node_priority": PRIO + " SELECT query_id, node_id, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS priority FROM pr",
    "edge_priority": f"""{PRIO}, {INDUCED}, ep AS (SELECT i.query_id, edge_type, round((a.relevance + b.relevance) / 2 + {IMPORTANCE}, 9) AS s FROM i
  JOIN rel a ON a.query_id = i.query_id AND a.node_id = src JOIN rel b ON b.query_id = i.query_id AND b.node_id = dst WHERE rn <= 500)
SELECT query_id, edge_type, CASE WHEN s >= 0.7 THEN 'critical' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS priority, count(*) AS edges FROM ep GROUP BY 1, 2, 3""",
    "meaningless_filter": f"""WITH x AS (SELECT conv_id, turn, trim(text, chr(32) || chr(10) || chr(9)) AS t, trim(regexp_replace(text, '[\\p{{L}} ]', '', 'g'), chr(10) || chr(9)) AS u FROM conversations)
SELECT conv_id, turn, {MEANINGLESS} AS meaningless, {MEANINGLESS.replace('(t,', '(u,').replace('(t)', '(u)')} AS stripped FROM x""",
    "answer_run": """SELECT count(*) AS queries, count(*) FILTER (NOT regexp_matches(text, '[0-9]')) AS answered, round(count(*) FILTER (NOT regexp_matches(text, '[0-9]')) / count(*) * 100, 1) AS success_rate FROM conversations""",
    "memory_fifo": kept("turn DESC"),
    "memory_relevance": kept(f"round(relevance + greatest(0.0, 1.0 - (({NOW} - tsec) / 3600.0) / 24) * 0.3, 9) DESC, turn"),
    "memory_frequency": f"""WITH {TURNS}, w AS (SELECT session_id, turn, lower(unnest(keywords)) AS w FROM turns), c AS (SELECT session_id, w, count(*) AS n FROM w GROUP BY 1, 2),
s AS (SELECT session_id, turn, sum(n) AS score FROM w JOIN c USING (session_id, w) GROUP BY 1, 2),
r AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(score, 0) DESC, turn) AS rk, count(*) OVER (PARTITION BY session_id) AS n FROM turns LEFT JOIN s USING (session_id, turn))
SELECT session_id, turn FROM r WHERE rk <= greatest(3, floor(n * 0.3))""",
    "memory_hybrid": f"""WITH {TURNS}, b AS (SELECT *, max(relevance) OVER (PARTITION BY session_id) AS best FROM turns), p AS (SELECT * FROM b WHERE relevance >= 0.3 OR best < 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rk, count(*) OVER (PARTITION BY session_id) AS n FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY relevance DESC, turn) AS orank FROM r WHERE n > 10 AND rk <= n - n // 2)
SELECT session_id, turn FROM r WHERE n <= 10 OR rk > n - n // 2 UNION ALL SELECT session_id, turn FROM o WHERE orank <= 10 - n // 2""",
    "memory_window": f"WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rk FROM turns) SELECT session_id, turn FROM r WHERE rk <= 10",
    "memory_kinds": f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rk, CAST(session_id[3:] AS INTEGER) % 6 AS kind FROM turns)
SELECT session_id, turn FROM r WHERE kind = 0 OR (kind IN (1, 3, 4) AND rk <= 10) OR rk <= 5""",
    "kept_histories": f"""WITH {TURNS} SELECT session_id, turn, tokens, tsec AS at, array_to_string(keywords, '|') AS keywords FROM turns WHERE session_id <> 's-3' OR turn % 100 >= 2""",
    "memory_check": f"WITH {TURNS} SELECT session_id, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) > 4000 OR count(*) > 20 AS compress FROM turns GROUP BY 1",
    "memory_stats": f"WITH {TURNS} SELECT session_id, count(*) AS total_turns, CAST(sum(tokens) AS BIGINT) AS total_tokens, min(tsec) AS oldest, max(tsec) AS newest FROM turns GROUP BY 1",
    "session_summary": f"""WITH {TURNS}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rk FROM turns),
w AS (SELECT session_id, turn, unnest(keywords[1:3]) AS w, generate_subscripts(keywords[1:3], 1) AS p FROM l WHERE rk <= 5),
c AS (SELECT session_id, lower(w) AS w, count(*) AS n, min(turn * 10 + p) AS seen FROM w GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, seen) AS rk FROM c)
SELECT s.session_id, s.n AS total_turns, (SELECT string_agg(w, ', ' ORDER BY rk) FROM t WHERE t.session_id = s.session_id AND rk <= 5) AS topics FROM (SELECT session_id, count(*) AS n FROM turns GROUP BY 1) s""",
    "cache_ttl": """WITH l AS (SELECT user_id || '-' || event_type AS key, max(ts) AS ts, max_by(value, ts) AS value FROM events GROUP BY 1)
SELECT key, value FROM l WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY ts DESC, key LIMIT 50""",
    "usage_stats": """WITH c AS (SELECT CAST(props->>'$.k' AS BIGINT) AS tokens, value AS seconds, event_type FROM events)
SELECT count(*) AS total_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(seconds), 2) AS total_time, round(avg(seconds), 2) AS average_time, count(*) FILTER (event_type = 'view') AS cache_hits,
  count(*) FILTER (event_type = 'error') AS failed_calls, round(count(*) FILTER (event_type = 'view') / count(*) * 100, 1) AS cache_efficiency, round(count(*) FILTER (event_type <> 'error') / count(*) * 100, 1) AS success_rate,
  round(sum(tokens) / count(*), 6) AS avg_tokens_per_call, round(count(*) / greatest(sum(seconds) / 60, 1.0), 6) AS calls_per_minute FROM c""",
}
