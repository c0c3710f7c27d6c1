"""Catalogue: text cleaning, document structure, BibTeX and metadata integration.

The tables hold prose without headings, so ``paper_texts`` lays every whole document
out as a paper (title, abstract in four styles or none, keywords, introduction,
references) and ``bibtex_entries`` writes every order as an entry; both grow with
their tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarweave.functions import documents as docs
from scholarweave.functions import text as tx
from scholarweave.operators.fuzzy import containment, match_references
from scholarweave.operators.ranking import distribution
from scholarweave.sources import bibtex
from scholarweave.sources import tables as t


def documents(spark, d):
    return t.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def paper_texts(spark, d):
    """doc_id, paper: the whole document as a structured paper with two references."""
    rows = documents(spark, d)
    bench = t.table(spark, d, "benchmark").select("item_id", F.col("text").alias("cited"))
    items = bench.select(F.count("*")).scalar()
    flat = F.regexp_replace("text", r"\s+", " ")
    style = F.col("doc_id") % 5
    abstract = (
        F.when(style == 0, F.concat(F.lit("Abstract\n"), flat))
        .when(style == 1, F.concat(F.lit("Abstract: "), flat))
        .when(style == 2, F.concat(F.lit("ABSTRACT\n"), flat))
        .when(style == 3, F.concat(F.lit("Abstract - "), flat))
        .otherwise(flat)
    )
    paper = F.concat(
        F.lit("A study of the collection named "), F.col("source"), F.lit("\n\n"),
        abstract, F.lit("\n\nKeywords: "), F.col("source"), F.lit(", Battery; "), F.col("lang"), F.lit(" corpus\n\nIntroduction\n"),
        F.col("text"), F.lit("\nReferences\n[1] Smith J. Miller. \""), F.col("cited"), F.lit("\" Journal of Words, 20"),
        F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"),
        F.lit(".\n[2] Jones wrote. Another survey of the language "), F.col("lang"), F.lit(" and its uses 2015.\n[3] short\nAppendix\nnothing more"),
    )
    return rows.withColumn("item_id", F.col("doc_id") % items).join(bench, "item_id").select("doc_id", paper.alias("paper"), "source", "lang")


def bibtex_entries(spark, d):
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    customers = t.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = t.table(spark, d, "nation").select("n_nationkey", "n_name")
    entry = F.format_string(
        'article{order_%d,\n  title = {A {Battery} study for %s and deep {learning}},\n  author = {%s and Buyer, %s University},\n'
        '  year = "%d",\n  journal={IEEE Trans. Smart Grid {%s}},\n  keywords = {%s; %s, AI , ev}\n}',
        "o_orderkey", "c_mktsegment", "c_name", "n_name", "y", "n_name", "c_mktsegment", "o_orderpriority",
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(entry.alias("entry"), F.format_string("/bib/Ord_%d.txt", F.col("o_orderkey") % 150).alias("bibtex_file"))
    )


def text_clean(spark, d):
    c = F.col("text")
    return documents(spark, d).select(
        "doc_id", tx.clean_bibtex(c).alias("bibtex"), tx.clean_model_input(c).alias("model"), tx.clean_node_text(c).alias("node")
    )


def text_truncate(spark, d):
    c = F.col("text")
    return documents(spark, d).select(
        "doc_id", tx.truncate_words(c, 20).alias("head"), tx.token_estimate(c).alias("tokens"), tx.word_token_estimate(c).alias("word_tokens")
    )


def stopwords(spark, d):
    return documents(spark, d).select("doc_id", tx.remove_stopwords(F.col("text")).alias("text"))


def dictionary_keywords(spark, d):
    return documents(spark, d).select(
        "doc_id",
        F.array_join(tx.technical_terms(F.col("text")), ",").alias("technical"),
        F.array_join(tx.title_terms(F.col("text")), ",").alias("title_terms"),
    )


def frequent_terms(spark, d):
    return docs.frequent_terms(documents(spark, d), "doc_id", "text", 2, 15)


def author_clean(spark, d):
    name = F.concat("s_name", F.lit(", Dr. "), F.col("s_nationkey").cast("string"))
    rows = t.table(spark, d, "supplier")
    return rows.select("s_suppkey", tx.clean_author(name).alias("cleaned"), tx.normalize_author(F.col("s_name")).alias("normalized"))


def journal_normalize(spark, d):
    raw = F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in JOURNALS]), (F.col("o_orderkey") % len(JOURNALS) + 1).cast("int")), "o_orderstatus")
    return t.table(spark, d, "orders").select("o_orderkey", tx.normalize_journal(raw).alias("journal"))


JOURNALS = ["ieee trans. smart grid", "Appl. Energy", "J Power Sources", "sci rep", "acta  materialia", "Nat. Commun", "neurocomputing"]


def keyword_merge(spark, d):
    rows = documents(spark, d)
    return rows.select(
        "doc_id", F.array_join(tx.merge_keywords(F.split("text", r"[ \n]"), F.array("source", "lang")), "|").alias("keywords")
    )


def model_input(spark, d):
    return documents(spark, d).select("doc_id", tx.model_input(F.col("source"), F.col("text")).alias("input_text"))


def title_extract(spark, d):
    return documents(spark, d).select("doc_id", docs.find_title(F.col("text")).alias("title"))


def keywords_section(spark, d):
    return paper_texts(spark, d).select("doc_id", F.array_join(docs.keyword_section(F.col("paper")), "|").alias("keywords"))


def abstract_extract(spark, d):
    return docs.with_abstract(paper_texts(spark, d), "paper").select("doc_id", "abstract")


def abstract_mentions(spark, d):
    found = docs.abstract_mentions(F.col("paper"))
    return paper_texts(spark, d).select("doc_id", F.posexplode(found).alias("nr", "context"))


def reference_split(spark, d):
    return docs.references(paper_texts(spark, d), "doc_id", "paper")


def reference_fields(spark, d):
    info = docs.reference_info(F.col("reference"))
    rows = reference_split(spark, d).withColumn("i", info)
    return rows.select("doc_id", "nr", "i.title", "i.year", "i.author", F.round("i.confidence", 6).alias("confidence"))


def document_keywords(spark, d):
    found = docs.document_keywords(paper_texts(spark, d), "doc_id", "paper")
    return found.select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def bibtex_parse(spark, d):
    rows = bibtex.parse_entries(bibtex_entries(spark, d))
    return rows.select(
        "bibtex_key", "title", F.array_join("authors", "|").alias("authors"), F.array_join("institutions", "|").alias("institutions"),
        "year", "journal", F.array_join("keywords", "|").alias("keywords"),
    )


def bibtex_papers(spark, d):
    """Parsed entries with PDFs: every second file name differs from its stem in case."""
    name = F.when(F.col("s_suppkey") % 2 == 0, F.lit("/pdf/Ord_%d.pdf")).otherwise(F.lit("/pdf/ORD_%d.pdf"))
    pdfs = t.table(spark, d, "supplier").select(F.replace(name, F.lit("%d"), F.col("s_suppkey").cast("string")).alias("pdf_file"))
    return bibtex.match_pdfs(bibtex.parse_entries(bibtex_entries(spark, d)), pdfs)


def parsing_stats(spark, d):
    out = docs.parsing_statistics(bibtex_papers(spark, d))
    return out.withColumn("avg_authors_per_paper", F.round("avg_authors_per_paper", 6))


def integrated(spark, d):
    """Documents as papers titled by source; keywords and abstracts joined by title."""
    papers = documents(spark, d).select(
        F.col("doc_id").alias("paper_id"), F.concat_ws(" ", F.upper("source"), "lang").alias("title"),
        F.when(F.col("lang") == "fr", F.array()).otherwise(F.array(F.lit("Corpus"), F.col("lang"), F.col("source"))).cast("array<string>").alias("keywords"),
    )
    kw = documents(spark, d).select(
        F.concat_ws(" ", "source", "lang").alias("title"), F.col("doc_id").alias("seq"), F.slice(F.split("text", r"[ \n]"), 1, 3).alias("pdf_keywords")
    ).filter("title NOT LIKE '%es'")
    ab = documents(spark, d).select(F.concat_ws(" ", "source", "lang").alias("title"), F.col("doc_id").alias("seq"), F.col("text").alias("abstract"))
    return docs.integrate(papers, kw, ab.filter("title NOT LIKE '%de'"))


def integrate_metadata(spark, d):
    return integrated(spark, d).select(
        "paper_id", F.array_join("keywords", "|").alias("keywords"), F.array_join("keyword_sources", "|").alias("keyword_sources"),
        "total_keyword_count", "bibtex_keyword_count", "pdf_keyword_count", "has_abstract", "abstract",
    )


def integration_stats(spark, d):
    out = docs.integration_statistics(integrated(spark, d))
    return out.withColumn("average_abstract_length", F.round("average_abstract_length", 6))


def keyword_enrichment(spark, d):
    rows = documents(spark, d)
    papers = rows.select(F.col("doc_id").alias("paper_id"), (F.col("lang") != "es").alias("has_pdf"), F.array("source", "lang").alias("keywords"))
    got = rows.filter("source <> 'src3'").select(
        F.col("doc_id").alias("paper_id"), F.lit(True).alias("found"), (F.length("text") < 200).alias("failed"),
        tx.technical_terms(F.col("text")).alias("keywords"),
    )
    out = docs.enrich_papers(papers, got)
    return out.select("paper_id", "keyword_source", F.array_join("keywords", "|").alias("keywords"))


def text_lengths(spark, d):
    sized = documents(spark, d).select(F.size(tx.words(tx.model_input(F.col("source"), F.col("text")))).alias("tokens"))
    return distribution(sized, "tokens", [0.5, 0.95]).select("metric", F.round("value", 6).alias("value"))


def citation_match_contains(spark, d):
    """Documents that contain a whole benchmark passage (the substring half of reference matching)."""
    passages = t.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return containment(documents(spark, d), passages)


def citation_match_fuzzy(spark, d):
    """References found in the papers matched to the passages as titles."""
    refs = reference_split(spark, d).withColumn("i", docs.reference_info(F.col("reference")))
    refs = refs.select(F.concat_ws("-", "doc_id", "nr").alias("ref_id"), F.col("i.title").alias("title"), F.col("i.year").alias("year"))
    titles = t.table(spark, d, "benchmark").select(F.col("item_id").alias("paper_id"), F.col("text").alias("title"))
    return match_references(refs, titles).select("ref_id", "paper_id", F.round("similarity", 6).alias("similarity"))


def bibtex_pdf_match(spark, d):
    return bibtex_papers(spark, d).select("bibtex_key", "pdf_file", "has_pdf")


QUERIES = {
    f.__name__: f
    for f in (
        text_clean, text_truncate, stopwords, dictionary_keywords, frequent_terms, author_clean, journal_normalize,
        keyword_merge, model_input, title_extract, keywords_section, abstract_extract, abstract_mentions, reference_split,
        reference_fields, document_keywords, bibtex_parse, bibtex_pdf_match, parsing_stats, integrate_metadata,
        integration_stats, keyword_enrichment, text_lengths, citation_match_contains, citation_match_fuzzy,
    )
}

# White space and word characters as Unicode classes, for an engine whose \\s and \\w are ASCII.
S = r"[\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]"
_w = r"\p{L}\p{N}_"


def collapse_sql(x):
    return f"regexp_replace(regexp_replace({x}, '{S}+', ' ', 'g'), '^ | $', '', 'g')"


def words_sql(x):
    return f"list_filter(string_split_regex({x}, '{S}+'), lambda w: w <> '')"


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def terms_sql(x, terms):
    return f"list_filter([{quoted(terms)}], lambda k: contains(lower({x}), lower(k)))"


from scholarweave import fixed_values as fv  # noqa: E402

CLEAN_MODEL = collapse_sql(f"regexp_replace(text, '[^{_w}\\s\\x{{85}}\\p{{Z}}.,;:!?\\-()]', ' ', 'g')")
CLEAN_NODE = collapse_sql(f"regexp_replace(text, '[^{_w}\\s\\x{{85}}\\p{{Z}}\\-.,()]', ' ', 'g')")
STOP_ALL = quoted(fv.ENGLISH_STOPWORDS + fv.PAPER_STOPWORDS)


def terms_rows_sql(source, key, text):
    """CTEs ending in ranked terms per key: rt(key, term, freq, rk)."""
    return f"""tok AS (SELECT {key} AS k, list_filter({words_sql(f"regexp_replace(lower({text}), '[^{_w}' || '\\s\\x{{85}}\\p{{Z}}]', ' ', 'g')")},
    lambda w: length(w) > 2 AND regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains([{STOP_ALL}], w)) AS t FROM {source}),
all_terms AS (SELECT k, list_concat(t, list_transform(list_zip(t[:-2], t[2:]), lambda z: z[1] || ' ' || z[2])) AS a FROM tok),
ex AS (SELECT k, unnest(a) AS term, generate_subscripts(a, 1) AS i FROM all_terms),
cnt AS (SELECT k, term, count(*) AS freq, min(i) AS f FROM ex GROUP BY 1, 2),
rt AS (SELECT k, term, freq, row_number() OVER (PARTITION BY k ORDER BY freq DESC, f) AS rk FROM cnt)"""


PAPER_TEXT = r"""paper AS (
  SELECT doc_id, source, lang, 'A study of the collection named ' || source || chr(10) || chr(10) ||
    CASE doc_id % 5 WHEN 0 THEN 'Abstract' || chr(10) || flat WHEN 1 THEN 'Abstract: ' || flat WHEN 2 THEN 'ABSTRACT' || chr(10) || flat
      WHEN 3 THEN 'Abstract - ' || flat ELSE flat END ||
    chr(10) || chr(10) || 'Keywords: ' || source || ', Battery; ' || lang || ' corpus' || chr(10) || chr(10) || 'Introduction' || chr(10) || text ||
    chr(10) || 'References' || chr(10) || '[1] Smith J. Miller. "' || cited || '" Journal of Words, 20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || '.' ||
    chr(10) || '[2] Jones wrote. Another survey of the language ' || lang || ' and its uses 2015.' || chr(10) || '[3] short' || chr(10) || 'Appendix' || chr(10) || 'nothing more' AS paper
  FROM (SELECT doc_id, source, lang, text, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents)
  JOIN (SELECT item_id, text AS cited FROM benchmark) ON item_id = doc_id % (SELECT count(*) FROM benchmark))"""
# The abstract as laid out, by splitting at its heading; lines are looked at where that length is not usable.
ABS = f"""ab AS (SELECT doc_id, paper, source, lang, {collapse_sql("a")} AS a, l FROM (
  SELECT *, CASE WHEN doc_id % 5 = 4 THEN '' ELSE
    regexp_extract(paper, '(?is)Abstract[:\\-\\s]*[:\\-\\n]\\s*(.*?)(?:\\n\\s*\\n)', 1) END AS a,
    list_filter(string_split(split_part(paper, chr(10) || 'Keywords', 1), chr(10)), lambda s: s <> '' AND NOT starts_with(s, 'A study of')) AS l FROM paper)),
fin AS (SELECT doc_id, paper, source, lang, CASE WHEN doc_id % 5 = 4 THEN '' WHEN length(a) BETWEEN 50 AND 3000 THEN regexp_replace(a, '^[:\\-\\s]+', '')
    WHEN length(f) BETWEEN 50 AND 3000 THEN f ELSE '' END AS abstract FROM
  (SELECT *, {collapse_sql("array_to_string(list_filter(l, lambda s: lower(trim(s)) <> 'abstract' AND length(trim(s)) > 10), ' ')")} AS f FROM ab))"""
REFS = r"""refs AS (SELECT doc_id, unnest([1, 2]) AS i, unnest([
   '[1] Smith J. Miller. "' || regexp_replace(cited, '\s+', ' ', 'g') || '" Journal of Words, 20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || '.',
   'Jones wrote. Another survey of the language ' || lang || ' and its uses 2015.']) AS reference,
   unnest([regexp_replace(cited, '\s+', ' ', 'g'), 'Another survey of the language ' || lang || ' and its uses']) AS title,
   unnest(['20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0'), '2015']) AS year
  FROM documents JOIN (SELECT item_id, text AS cited FROM benchmark) ON item_id = doc_id % (SELECT count(*) FROM benchmark))"""
BIB = """bib AS (SELECT 'order_' || o_orderkey AS bibtex_key, c_mktsegment, c_name, n_name, o_orderpriority, o_orderkey,
   CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
BIBROW = """parsed AS (SELECT bibtex_key, 'A Battery study for ' || c_mktsegment || ' and deep learning' AS title,
   c_name || '|' || n_name || ' University Buyer' AS authors, n_name || ' University' AS institutions, year,
   'IEEE Trans. Smart Grid ' || n_name AS journal,
   array_to_string(list_filter([lower(c_mktsegment), lower(o_orderpriority), 'deep learning', 'battery'], lambda k: length(k) > 2), '|') AS keywords,
   o_orderkey % 150 AS stem FROM bib)"""
INTEGRATED = """p AS (SELECT doc_id AS paper_id, source || ' ' || lang AS k, CASE WHEN lang = 'fr' THEN CAST([] AS VARCHAR[]) ELSE ['Corpus', lang, source] END AS b FROM documents),
kwd AS (SELECT source || ' ' || lang AS k, min_by(string_split_regex(text, '[ \n]')[1:3], doc_id) AS pk FROM documents WHERE lang <> 'es' GROUP BY 1),
abd AS (SELECT source || ' ' || lang AS k, min_by(text, doc_id) AS abstract FROM documents WHERE lang <> 'de' GROUP BY 1),
i AS (SELECT paper_id, b, coalesce(pk, CAST([] AS VARCHAR[])) AS pk, coalesce(abstract, '') AS abstract FROM p LEFT JOIN kwd USING (k) LEFT JOIN abd USING (k)),
m AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(list_concat(b, pk), lambda x: trim(lower(x))), lambda x: length(x) > 2))) AS merged FROM i)"""

SQL = {
    "text_clean": f"SELECT doc_id, {collapse_sql('text')} AS bibtex, {CLEAN_MODEL} AS model, {CLEAN_NODE} AS node FROM documents".replace(collapse_sql("text"), collapse_sql("regexp_replace(text, '[{}]', '', 'g')")),
    "text_truncate": f"""SELECT doc_id, CASE WHEN len({words_sql('text')}) <= 20 THEN text ELSE array_to_string({words_sql('text')}[1:20], ' ') END AS head,
       length(text) // 4 AS tokens, CAST(floor(len({words_sql('text')}) * 1.3) AS BIGINT) AS word_tokens FROM documents""",
    "stopwords": f"""SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: NOT list_contains([{quoted(fv.NODE_STOPWORDS_KO + fv.NODE_STOPWORDS_EN)}], lower(w))), ' ') AS text FROM documents""",
    "dictionary_keywords": f"""SELECT doc_id, array_to_string({terms_sql('text', fv.TECHNICAL_TERMS)}, ',') AS technical,
       array_to_string({terms_sql('text', fv.TITLE_TERMS)}, ',') AS title_terms FROM documents""",
    "frequent_terms": f"WITH {terms_rows_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, term, freq, CAST(rk AS INTEGER) AS rank FROM rt WHERE rk <= 15 AND freq >= 2",
    "author_clean": """SELECT s_suppkey, regexp_replace('Dr. ' || s_nationkey || ' ' || s_name, '#', ' ') AS cleaned, lower(regexp_replace(s_name, '#', ' ')) AS normalized FROM supplier""",
    "journal_normalize": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'IEEE Transactions on Smart Grid' WHEN 1 THEN 'Applied Energy' WHEN 2 THEN 'Journal of Power Sources'
   WHEN 3 THEN 'Scientific Reports' WHEN 4 THEN 'Acta materialia ' || o_orderstatus WHEN 5 THEN 'Nature Communications' ELSE 'Neurocomputing' END AS journal FROM orders""",
    "keyword_merge": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(string_split_regex(text, '[ \\n]'), [source, lang]),
   lambda x: lower(regexp_replace(x, '^{S}+|{S}+$', '', 'g'))), lambda x: length(x) > 2))), '|') AS keywords FROM documents""",
    "model_input": f"""SELECT doc_id, 'Title: ' || source || CASE WHEN c <> '' THEN ' Abstract: ' || c ELSE '' END AS input_text FROM (SELECT doc_id, source, {CLEAN_MODEL} AS c FROM documents)""",
    "title_extract": f"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda s: regexp_replace(s, '^{S}+|{S}+$', '', 'g')),
   lambda s: length(s) > 20 AND NOT regexp_matches(s, '^\\p{{Nd}}') AND NOT regexp_matches(lower(s), '^(abstract|introduction|keywords)') AND len({words_sql('s')}) > 3)[1], '') AS title FROM documents""",
    "keywords_section": """SELECT doc_id, array_to_string(list_sort(['battery', lang || ' corpus', source]), '|') AS keywords FROM documents""",
    "abstract_extract": f"WITH {PAPER_TEXT}, {ABS} SELECT doc_id, abstract FROM fin",
    "reference_split": f"WITH {REFS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS nr, reference FROM refs",
    "reference_fields": f"""WITH {REFS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS nr, trim(title) AS title, year, '' AS author,
   CASE WHEN i = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM refs""",
    "document_keywords": f"""WITH {PAPER_TEXT}, {ABS},
{terms_rows_sql('fin', 'doc_id', 'abstract')},
{terms_rows_sql('fin', 'doc_id', 'paper').replace('tok', 'tok2').replace('all_terms', 'all2').replace('ex AS', 'ex2 AS').replace('FROM ex ', 'FROM ex2 ').replace('cnt', 'cnt2').replace('rt AS', 'rt2 AS')},
la AS (SELECT k, list(term ORDER BY rk) AS a FROM rt WHERE rk <= 10 GROUP BY 1), lf AS (SELECT k, list(term ORDER BY rk) AS f FROM rt2 WHERE rk <= 15 AND freq >= 2 GROUP BY 1),
u AS (SELECT doc_id, list_concat(list_concat(list_concat(list_sort(['battery', lang || ' corpus', source]), {terms_sql('paper', fv.TECHNICAL_TERMS)}), coalesce(a, [])), coalesce(f, [])) AS m
  FROM fin LEFT JOIN la ON la.k = doc_id LEFT JOIN lf ON lf.k = doc_id),
e AS (SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM u),
d AS (SELECT doc_id, w, min(i) AS i FROM e WHERE length(w) > 2 GROUP BY 1, 2)
SELECT doc_id, string_agg(w, '|' ORDER BY i) AS keywords FROM d GROUP BY 1""",
    "bibtex_parse": f"WITH {BIB}, {BIBROW} SELECT bibtex_key, title, authors, institutions, year, journal, keywords FROM parsed",
    "bibtex_pdf_match": f"""WITH {BIB}, {BIBROW} SELECT bibtex_key, CASE WHEN s_suppkey % 2 = 0 THEN '/pdf/Ord_' ELSE '/pdf/ORD_' END || s_suppkey || '.pdf' AS pdf_file, s_suppkey IS NOT NULL AS has_pdf
   FROM parsed LEFT JOIN supplier ON s_suppkey = stem""",
    "parsing_stats": f"""WITH {BIB}, {BIBROW}, k AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest(string_split(keywords, '|')) AS w FROM parsed))
SELECT count(*) AS total_papers, count(s_suppkey) AS papers_with_pdf, count(*) - count(s_suppkey) AS papers_without_pdf, count(*) AS papers_with_keywords,
  2.0::DOUBLE AS avg_authors_per_paper, (SELECT count(DISTINCT a) FROM (SELECT unnest(string_split(authors, '|')) AS a FROM parsed)) AS total_unique_authors,
  count(DISTINCT institutions) AS total_unique_institutions, (SELECT n FROM k) AS total_unique_keywords FROM parsed LEFT JOIN supplier ON s_suppkey = stem""",
    "integrate_metadata": f"""WITH {INTEGRATED} SELECT paper_id, array_to_string(merged, '|') AS keywords,
   CASE WHEN len(b) > 0 AND len(pk) > 0 THEN 'bibtex|pdf' WHEN len(b) > 0 THEN 'bibtex' WHEN len(pk) > 0 THEN 'pdf' ELSE 'none' END AS keyword_sources,
   CAST(len(merged) AS INTEGER) AS total_keyword_count, CAST(len(b) AS INTEGER) AS bibtex_keyword_count, CAST(len(pk) AS INTEGER) AS pdf_keyword_count,
   abstract <> '' AS has_abstract, abstract FROM m""",
    "integration_stats": f"""WITH {INTEGRATED} SELECT count(*) AS total_papers, count(*) FILTER (len(b) > 0 AND len(pk) = 0) AS bibtex_only, count(*) FILTER (len(b) = 0 AND len(pk) > 0) AS pdf_only,
   count(*) FILTER (len(b) > 0 AND len(pk) > 0) AS both_sources, count(*) FILTER (len(b) = 0 AND len(pk) = 0) AS no_keywords, CAST(sum(len(b)) AS BIGINT) AS total_bibtex_keywords,
   CAST(sum(len(pk)) AS BIGINT) AS total_pdf_keywords, CAST(sum(len(merged)) AS BIGINT) AS total_integrated_keywords, count(*) FILTER (abstract <> '') AS papers_with_abstracts,
   count(*) FILTER (length(abstract) > 50) AS papers_with_meaningful_abstracts, round(avg(length(abstract)) FILTER (abstract <> ''), 6) AS average_abstract_length,
   (SELECT count(DISTINCT x) FROM (SELECT unnest(merged) AS x FROM m)) AS unique_integrated_keywords FROM m""",
    "keyword_enrichment": f"""WITH s AS (SELECT doc_id, lang, source, {terms_sql('text', fv.TECHNICAL_TERMS)} AS t,
   CASE WHEN lang = 'es' THEN 'no_pdf' WHEN source = 'src3' THEN 'pdf_not_found' WHEN length(text) < 200 THEN 'pdf_failed' ELSE 'pdf_extracted' END AS st FROM documents)
SELECT doc_id AS paper_id, st AS keyword_source, array_to_string(CASE WHEN st = 'pdf_extracted' THEN list_concat([source, lang], t) ELSE [source, lang] END, '|') AS keywords FROM s""",
    "text_lengths": f"""WITH n AS (SELECT len({words_sql("'Title: ' || source || CASE WHEN c <> '' THEN ' Abstract: ' || c ELSE '' END")}) AS n FROM (SELECT source, {CLEAN_MODEL} AS c FROM documents))
SELECT unnest(['count', 'mean', 'std', 'min', 'max', 'p50', 'p95']) AS metric, unnest([count(*)::DOUBLE, round(avg(n), 6), round(stddev_pop(n), 6), min(n)::DOUBLE, max(n)::DOUBLE,
   round(quantile_cont(n, 0.5), 6), round(quantile_cont(n, 0.95), 6)]) AS value FROM n""",
    "citation_match_contains": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
}
