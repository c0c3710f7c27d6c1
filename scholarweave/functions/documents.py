"""Structure of a paper's full text: title, abstract, keyword section, references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarweave.fixed_values import (
    ABSTRACT_PATTERNS,
    INSTITUTION_PATTERNS,
    KEYWORD_SECTION_PATTERNS,
    REFERENCE_AUTHOR,
    REFERENCE_ENDS,
    REFERENCE_HEADERS,
    REFERENCE_SPLITS,
    REFERENCE_TITLE,
    REFERENCE_YEAR,
    TECHNICAL_TERMS,
)
from scholarweave.functions.text import clean_bibtex, collapse, content_terms, content_tokens, merge_keywords, split_list, strip, terms_in, text_or_empty, words
from scholarweave.operators.ranking import top_per_group
from scholarweave.session import durable


def _between(text: Column, low: int, high: int) -> Column:
    return (F.length(text) >= low) & (F.length(text) <= high)


def find_title(text: Column) -> Column:
    """The first of ten lines that reads like a title, else empty."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), strip)
    fits = F.filter(
        lines,
        lambda s: (F.length(s) > 20)
        & ~s.rlike(r"^\p{Nd}")
        & ~F.lower(s).rlike(r"^(abstract|introduction|keywords)")
        & (F.size(words(s)) > 3),
    )
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(""))


def keyword_section(text: Column) -> Column:
    """Lower-case entries of every keyword section, distinct and sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in KEYWORD_SECTION_PATTERNS]
    entries = F.flatten(F.transform(F.concat(*found), lambda m: split_list(collapse(m))))
    return F.array_sort(F.array_distinct(F.transform(entries, F.lower)))


def with_abstract(docs: DataFrame, text: str, name: str = "abstract") -> DataFrame:
    """Adds the abstract: first pattern whose hit has 50 to 3,000 characters, else line by line.

    Line by line means up to twenty lines from the first that mentions an abstract, until
    keywords or introduction. Case is ignored, so patterns that differ in case only are
    searched once. Every step is a projection of its own: array functions are not
    shared inside one expression, and a split or search must not run twice.
    """
    patterns = {p.lower(): p for p in reversed(ABSTRACT_PATTERNS)}
    ordered = [p for p in ABSTRACT_PATTERNS if patterns[p.lower()] is p]
    hits = F.array(*[collapse(F.regexp_extract(text, p, 1)) for p in ordered])
    mentions = F.array_position(F.transform("_lines", lambda s: s.rlike(r"(?i)\babstract\b")), True).cast("int")
    block = F.transform(F.slice("_lines", F.greatest(F.col("_start"), F.lit(1)), F.lit(20)), strip)
    ends = F.transform("_block", lambda s: s.rlike(r"(?i)\b(keywords?|introduction|1\.?\s*introduction)\b"))
    body = F.when(F.col("_stop") > 0, F.slice("_block", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("_block"))
    kept = F.filter(body, lambda s: ~s.rlike(r"(?i)^\s*abstract\s*[:\-]?\s*$") & (F.length(s) > 10))
    by_lines = F.when((F.col("_start") > 0) & _between(F.col("_joined"), 50, 3000), F.col("_joined")).otherwise(F.lit(""))
    return (
        docs.withColumns({"_hits": hits, "_lines": F.split(text, "\n")})
        .withColumns({"_first": F.try_element_at(F.filter("_hits", lambda h: _between(h, 50, 3000)), F.lit(1)), "_start": mentions})
        .withColumn("_block", block)
        .withColumn("_stop", F.array_position(ends, True).cast("int"))
        .withColumn("_joined", collapse(F.array_join(kept, " ")))
        .withColumn(name, F.coalesce(F.regexp_replace("_first", r"^[:\-\s]+", ""), by_lines))
        .drop("_hits", "_lines", "_first", "_start", "_block", "_stop", "_joined")
    )


def abstract_mentions(text: Column) -> Column:
    """Every mention of 'abstract' with 50 characters before and 200 after (inspection aid)."""
    lowered = F.lower(text)
    pieces = F.split(lowered, "abstract")
    # position of each mention = length of everything before it
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda i: F.length(F.array_join(F.slice(pieces, F.lit(1), i), "abstract")),
    )
    cut = F.transform(
        ends, lambda e: F.substr(text, F.greatest(e - 49, F.lit(1)), F.least(e, F.lit(50)) + F.lit(8 + 200))
    )
    return F.when(F.size(pieces) > 1, cut).otherwise(F.array().cast("array<string>"))


def reference_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section): text after the first reference header, up to the earliest closing heading."""
    pieces = [F.split(text, header, 2) for header in dict.fromkeys(h.lower() for h in REFERENCE_HEADERS)]
    after = F.coalesce(*[F.when(F.size(p) == 2, F.element_at(p, -1)) for p in pieces], F.lit(""))
    ends = dict.fromkeys(e.lower() for e in REFERENCE_ENDS)
    cut = F.least(*[F.length(F.element_at(F.split("_after", end, 2), 1)) for end in ends])
    return docs.select(key, after.alias("_after")).select(key, F.substr("_after", F.lit(1), cut).alias("section"))


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nr, reference): entries by whichever of four separators yields most pieces, else by blank line.

    Each step is its own projection, so no split is computed twice.
    """
    ways = [F.split("section", p).alias(f"_w{i}") for i, p in enumerate(REFERENCE_SPLITS)]
    names = [f"_w{i}" for i in range(len(REFERENCE_SPLITS))]
    chosen = F.when(F.col("_most") <= 1, F.split("section", r"\n\s*\n"))
    for name in names:
        chosen = chosen.when(F.size(name) == F.col("_most"), F.col(name))
    entries = F.transform(F.filter(F.transform("_pieces", strip), lambda r: F.length(r) > 20), collapse)
    return (
        reference_sections(docs, key, text)
        .select(key, "section", *ways)
        .withColumn("_most", F.greatest(*[F.size(n) for n in names]))
        .select(key, chosen.alias("_pieces"))
        .select(key, F.posexplode(entries).alias("nr", "reference"))
    )


def reference_info(reference: Column) -> Column:
    """struct(title, year, author, confidence) of one reference."""
    year = F.regexp_extract(reference, REFERENCE_YEAR, 1)
    quoted = strip(F.regexp_extract(reference, '"([^"]+)"', 1))
    has_quote = reference.rlike('"[^"]+"')
    guessed = strip(F.regexp_extract(reference, REFERENCE_TITLE, 1))
    guessed = F.when(F.length(guessed) > 10, guessed).otherwise(F.lit(""))
    author = strip(F.regexp_extract(reference, REFERENCE_AUTHOR, 1))
    points = lambda test, p: F.when(test, F.lit(p)).otherwise(F.lit(0.0))
    return F.struct(
        F.when(has_quote, quoted).otherwise(guessed).alias("title"),
        year.alias("year"),
        author.alias("author"),
        (
            points(year != "", 0.3)
            + points(has_quote, 0.4)
            + points(~has_quote & (guessed != ""), 0.2)
            + points(author != "", 0.3)
        ).alias("confidence"),
    )


def author_names(field: Column) -> Column:
    """'Last, First and First Last' to a list of 'First Last' names; " and " inside braces of any depth is part of a name."""
    parts = F.split(F.regexp_replace(text_or_empty(field), r"(?i)(\s+and\s+)", "\x00$1\x00"), "\x00")  # names and what is between them, in turn
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("between")))
    braces = lambda t, brace: F.length(t) - F.length(F.replace(t, F.lit(brace), F.lit("")))
    nothing = F.struct(F.array().cast("array<string>").alias("names"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def add(state: Column, part: Column) -> Column:
        ends = part["between"] & (state["depth"] <= 0)
        return F.struct(
            F.when(ends, F.array_append(state["names"], state["open"])).otherwise(state["names"]).alias("names"),
            F.when(ends, "").otherwise(F.concat(state["open"], part["text"])).alias("open"),
            (state["depth"] + braces(part["text"], "{") - braces(part["text"], "}")).alias("depth"),
        )

    names = F.aggregate(numbered, nothing, add, lambda s: F.array_append(s["names"], s["open"]))
    people = F.filter(F.transform(names, clean_bibtex), lambda p: p != "")
    return F.transform(
        people,
        lambda p: F.when(
            F.contains(p, F.lit(",")), strip(F.concat_ws(" ", strip(F.substring_index(p, ",", -1)), strip(F.substring_index(p, ",", 1))))
        ).otherwise(p),
    )


def institutions(field: Column, author_text: Column) -> Column:
    """The institution field and everything that looks like one in the author text."""
    own = F.filter(F.array(clean_bibtex(field)), lambda v: v != "")
    cleaned = clean_bibtex(author_text)
    found = F.flatten(F.array(*[F.regexp_extract_all(cleaned, F.lit(p), 1) for p in INSTITUTION_PATTERNS]))
    return F.array_sort(F.array_distinct(F.concat(own, F.filter(F.transform(found, strip), lambda v: v != ""))))


def frequent_terms(docs: DataFrame, key: str, text: str, min_freq: int = 2, max_terms: int = 20) -> DataFrame:
    """(key, term, freq, rank): most frequent one- and two-word terms, first occurrence breaks ties.

    A document with a key of its own is counted where it lies, and its terms are not shuffled. Those that share a key
    are counted together by an aggregation.
    """
    repeated = durable(docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"))
    if repeated.isEmpty():
        return _terms_of_rows(docs, key, text, min_freq, max_terms)
    same = docs[key].eqNullSafe(repeated["_key"])
    alone = _terms_of_rows(docs.join(repeated, same, "left_anti"), key, text, min_freq, max_terms)
    return alone.unionByName(_terms_of_keys(docs.join(repeated, same, "left_semi"), key, text, min_freq, max_terms))


# Tokens that are counted at once; a longer document is counted by itself.
TOKENS = 1 << 19


def _terms_of_rows(docs: DataFrame, key: str, text: str, min_freq: int, max_terms: int) -> DataFrame:
    """``frequent_terms`` of documents whose keys are all different."""
    schema = T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("freq", T.LongType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, at = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
            while at < len(upto):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
                yield _count_terms(batch.slice(at, end - at), min_freq, max_terms)
                at = end

    return docs.select(key, content_tokens(F.col(text)).alias("_tokens")).mapInArrow(run, schema)


def _count_terms(rows: pa.RecordBatch, min_freq: int, max_terms: int) -> pa.RecordBatch:
    """(key, term, freq, rank) of rows (key, tokens). A term is a number: that of its token, or of its two tokens in turn."""
    sizes = pc.list_value_length(rows.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = rows.column(1).flatten().dictionary_encode()
    names, code = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, row = max(len(names), 1), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pair = np.flatnonzero(row[1:] == row[:-1])
    in_row = np.concatenate([row, row[pair]])
    term = np.concatenate([code, n + code[pair] * n + code[pair + 1]])
    place = np.concatenate([at, sizes[row[pair]] + at[pair]])
    both, first, freq = np.unique(in_row * (n + n * n) + term, return_index=True, return_counts=True)
    row, term, place = both // (n + n * n), both % (n + n * n), place[first]
    order = np.lexsort((place, -freq, row))
    row, term, freq = row[order], term[order], freq[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    kept = (rank <= max_terms) & (freq >= min_freq)
    row, term, freq, rank = row[kept], term[kept], freq[kept], rank[kept]
    left, right = np.where(term < n, term, (term - n) // n), np.where(term < n, term, (term - n) % n)
    pairs = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), " ")
    texts = pc.if_else(pa.array(term < n), names.take(pa.array(left)), pairs)
    columns = [rows.column(0).take(pa.array(row)), texts.cast(pa.string()), pa.array(freq, pa.int64()), pa.array(rank, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[rows.schema.names[0], "term", "freq", "rank"])


def _terms_of_keys(docs: DataFrame, key: str, text: str, min_freq: int, max_terms: int) -> DataFrame:
    """``frequent_terms`` of documents that may share a key."""
    tokens = docs.select(key, content_tokens(F.col(text)).alias("_tokens"))  # used several times below
    terms = tokens.select(key, F.posexplode(content_terms(F.col("_tokens"))).alias("pos", "term"))
    counted = terms.groupBy(key, "term").agg(F.count("*").alias("freq"), F.min("pos").alias("_first"))
    best = top_per_group(counted, [key], [F.desc("freq"), F.asc("_first")], max_terms)
    return best.filter(F.col("freq") >= min_freq).select(key, "term", "freq", "rank")


def _listed(terms: DataFrame, key: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))  # at most max_terms entries
    return terms.groupBy(key).agg(F.transform(ordered, lambda s: s["term"]).alias(name))


def document_keywords(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keywords): section entries, dictionary hits, abstract terms and text terms, in that order."""
    base = docs.select(key, F.col(text).alias("_t"))
    from_abstract = _listed(frequent_terms(with_abstract(base, "_t", "_abstract"), key, "_abstract", 1, 10), key, "_a")
    from_text = _listed(frequent_terms(base, key, "_t", 2, 15), key, "_f")
    none = F.array().cast("array<string>")
    # lists are made of the text before the joins, which then carry no text; lower-case text is a column of its own
    own = base.select(key, keyword_section(F.col("_t")).alias("_s"), F.lower(text_or_empty(F.col("_t"))).alias("_low"))
    own = own.select(key, "_s", terms_in(F.col("_low"), TECHNICAL_TERMS).alias("_d"))
    merged = F.concat("_s", "_d", F.coalesce("_a", none), F.coalesce("_f", none))
    tidy = F.array_distinct(F.filter(F.transform(merged, lambda k: strip(F.lower(k))), lambda k: F.length(k) > 2))
    return own.join(from_abstract, key, "left").join(from_text, key, "left").select(key, tidy.alias("keywords"))


def enrich_papers(papers: DataFrame, extracted: DataFrame) -> DataFrame:
    """Papers joined with extraction results: merged keywords and where they came from.

    ``papers`` has paper_id, has_pdf, keywords; ``extracted`` has paper_id, found, failed
    and keywords. A paper without a row in ``extracted`` has no file behind its link.
    """
    none = F.array().cast("array<string>")
    got = extracted.select("paper_id", F.col("keywords").alias("_k"), "found", "failed")
    status = (
        F.when(~F.col("has_pdf"), "no_pdf")
        .when(~F.coalesce("found", F.lit(False)), "pdf_not_found")
        .when(F.col("failed"), "pdf_failed")
        .otherwise("pdf_extracted")
    )
    return (
        papers.join(got, "paper_id", "left")
        .withColumn("keyword_source", status)
        .withColumn("pdf_keywords", F.when(F.col("keyword_source") == "pdf_extracted", F.coalesce("_k", none)).otherwise(none))
        .withColumn("keywords", F.array_union("keywords", "pdf_keywords"))
        .drop("_k", "found", "failed")
    )


def integrate(papers: DataFrame, pdf_keywords: DataFrame, pdf_abstracts: DataFrame) -> DataFrame:
    """Full metadata: the first title match of each source is joined on, keywords are merged.

    Each source has title, seq (its order) and its value; duplicates of a title are
    reduced to the first by aggregation before the join.
    """
    key = lambda df: strip(F.lower(df["title"]))
    kw = pdf_keywords.groupBy(key(pdf_keywords).alias("_key")).agg(F.min_by("pdf_keywords", "seq").alias("pdf_keywords"))
    ab = pdf_abstracts.groupBy(key(pdf_abstracts).alias("_key")).agg(F.min_by("abstract", "seq").alias("abstract"))
    none = F.array().cast("array<string>")
    own, pdf = F.size("bibtex_keywords") > 0, F.size("pdf_keywords") > 0
    return (
        papers.withColumnRenamed("keywords", "bibtex_keywords")
        .withColumn("_key", key(papers))
        .join(kw, "_key", "left")
        .join(ab, "_key", "left")
        .withColumn("pdf_keywords", F.coalesce("pdf_keywords", none))
        .withColumn("abstract", F.coalesce("abstract", F.lit("")))
        .withColumn("keywords", merge_keywords(F.col("bibtex_keywords"), F.col("pdf_keywords")))
        .withColumn(
            "keyword_sources",
            F.when(own & pdf, F.array(F.lit("bibtex"), F.lit("pdf")))
            .when(own, F.array(F.lit("bibtex")))
            .when(pdf, F.array(F.lit("pdf")))
            .otherwise(F.array(F.lit("none"))),
        )
        .withColumn("total_keyword_count", F.size("keywords"))
        .withColumn("bibtex_keyword_count", F.size("bibtex_keywords"))
        .withColumn("pdf_keyword_count", F.size("pdf_keywords"))
        .withColumn("has_abstract", F.col("abstract") != "")
        .drop("_key")
    )


def integration_statistics(integrated: DataFrame) -> DataFrame:
    """One row of totals over integrated metadata."""
    has = lambda s: F.array_contains("keyword_sources", s)
    unique = integrated.select(F.explode("keywords").alias("k")).distinct().select(F.count("*")).scalar()
    length = F.length("abstract")
    return integrated.agg(
        F.count("*").alias("total_papers"),
        F.count_if(has("bibtex") & ~has("pdf")).alias("bibtex_only"),
        F.count_if(has("pdf") & ~has("bibtex")).alias("pdf_only"),
        F.count_if(has("pdf") & has("bibtex")).alias("both_sources"),
        F.count_if(has("none")).alias("no_keywords"),
        F.sum("bibtex_keyword_count").alias("total_bibtex_keywords"),
        F.sum("pdf_keyword_count").alias("total_pdf_keywords"),
        F.sum("total_keyword_count").alias("total_integrated_keywords"),
        F.count_if("has_abstract").alias("papers_with_abstracts"),
        F.count_if(length > 50).alias("papers_with_meaningful_abstracts"),
        F.coalesce(F.avg(F.when(length > 0, length)), F.lit(0.0)).alias("average_abstract_length"),
    ).withColumn("unique_integrated_keywords", unique)


def parsing_statistics(papers: DataFrame) -> DataFrame:
    """One row over parsed entries: counts and distinct authors, institutions, keywords."""

    lists = ("authors", "institutions", "keywords")

    def tagged(name: str) -> Column:
        return F.transform(name, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("v")))

    values = papers.select(F.inline(F.flatten(F.array(*[tagged(c) for c in lists]))))
    unique = values.distinct().select(F.struct(*[F.count_if(F.col("kind") == c).alias(c) for c in lists])).scalar()
    base = papers.agg(
        F.count("*").alias("total_papers"),
        F.count_if("has_pdf").alias("papers_with_pdf"),
        F.count_if(~F.col("has_pdf")).alias("papers_without_pdf"),
        F.count_if(F.size("keywords") > 0).alias("papers_with_keywords"),
        F.avg(F.size("authors")).alias("avg_authors_per_paper"),
    )
    return base.withColumn("_u", unique).select(*base.columns, *[F.col(f"_u.{c}").alias(f"total_unique_{c}") for c in lists])
