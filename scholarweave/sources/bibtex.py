"""BibTeX files as a splittable text source, and the match between entries and PDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarweave.functions.documents import author_names, institutions
from scholarweave.functions.text import bibtex_keywords, clean_bibtex, strip

SKIPPED = ["string", "comment", "preamble"]
_HEAD = re.compile(r"@?\s*(\w+)\s*[{(]")
_NAME = re.compile(r"[\s,]*([^\s,={}\"#%()]+)\s*=\s*")
_KEY = re.compile(r"\s*([^,{}\s=\"]*)\s*(?=[,})]|\Z)")
_BARE = re.compile(r"[^\s,#{}\"()]+")
_MARKS = {"}": re.compile("[{}]"), '"': re.compile('[{}"]')}
_AGAIN = re.compile(r"@\s*(\w+)\s*[{(]")
_FIELDS = pa.map_(pa.string(), pa.list_(pa.struct([("macro", pa.bool_()), ("text", pa.string())])))
_PIECES = T.ArrayType(T.StructType().add("macro", "boolean").add("text", "string"))
_PARSED = T.StructType().add("_kind", "string").add("_key", "string").add("_fields", T.MapType(T.StringType(), _PIECES))


def read_entries(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(entry, bibtex_file): one row per entry.

    The record separator is a new line that starts with '@', so one large file is read
    by many tasks; bytes that are not UTF-8 are replaced by the text reader. Entries that are
    indented or follow another on its line stay in one record and are told apart by the parser.
    """
    rows = (
        spark.read.option("lineSep", "\n@").option("pathGlobFilter", glob).text(path)
        .select(F.regexp_replace("value", r"^\s*@", "").alias("entry"), F.col("_metadata.file_path").alias("bibtex_file"))
    )
    return rows.filter(F.col("entry").rlike(r"^\s*\w+\s*\{"))


def _value(text: str, at: int) -> tuple[list[dict], int]:
    """Pieces of a value, braced, quoted or bare and joined by '#', and the place after it."""
    pieces = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] in '{"':
            closing, depth, start = ("}" if text[at] == "{" else '"'), 0, at + 1
            at = len(text)
            for mark in _MARKS[closing].finditer(text, start):
                if depth == 0 and mark[0] == closing:
                    at = mark.start()
                    break
                depth += (mark[0] == "{") - (mark[0] == "}")
            pieces.append({"macro": False, "text": text[start:at]})
            at += 1
        elif bare := _BARE.match(text, at):
            pieces.append({"macro": not bare[0].isdigit(), "text": bare[0]})
            at = bare.end()
        else:
            return pieces, at
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] != "#":
            return pieces, at
        at += 1


def parse_record(text: str) -> list[dict]:
    """Entries (kind, key, fields) of one record: the first from its start, others where an '@' follows a closed entry."""
    out, head = [], _HEAD.match(text.lstrip())
    text = text.lstrip()
    while head:
        kind, at, key, fields = head[1].lower(), head.end(), "", {}
        if kind not in SKIPPED and (named := _KEY.match(text, at)):
            key, at = named[1], named.end()
        while name := _NAME.match(text, at):
            pieces, at = _value(text, name.end())
            fields.setdefault(name[1].lower(), pieces)
        out.append({"kind": kind, "key": key, "fields": fields})
        head = _AGAIN.search(text, at)
    return out


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each entry of a record: the record's other columns, kind, key and fields."""
    for batch in batches:
        row, found = [], []
        for at, text in enumerate(batch.column("entry").to_pylist()):
            entries = parse_record(text or "")
            found += entries
            row += [at] * len(entries)
        rest = [c for c in batch.schema.names if c != "entry"]
        columns = [batch.column(c).take(pa.array(row, pa.int64())) for c in rest]
        columns += [pa.array([e["kind"] for e in found], pa.string()), pa.array([e["key"] for e in found], pa.string()), pa.array([[*e["fields"].items()] for e in found], _FIELDS)]
        yield pa.RecordBatch.from_arrays(columns, names=[*rest, *_PARSED.names])


def _resolved(pieces: Column) -> Column:
    """Text of a value: macros replaced by what the file's @string entries say, unknown ones kept as they are."""
    return F.array_join(F.transform(pieces, lambda p: F.when(p.macro, F.coalesce(F.element_at(F.col("_macros"), F.lower(p.text)), p.text)).otherwise(p.text)), "")


def parse_entries(entries: DataFrame) -> DataFrame:
    """Paper metadata from raw entries; rows that are no publication are left out.

    Values keep braces of any depth; ``@string`` macros hold in their own file.
    """
    schema = T.StructType([f for f in entries.schema if f.name != "entry"] + _PARSED.fields)
    parsed = entries.mapInArrow(_parse_rows, schema)
    # only records that hold the word can define macros: no other is parsed for them
    defining = entries.filter(F.contains(F.lower("entry"), F.lit("string"))).mapInArrow(_parse_rows, schema)
    defined = defining.filter("_kind = 'string'").select("bibtex_file", F.explode("_fields").alias("name", "pieces"))
    plain = F.array_join(F.transform("pieces", lambda p: p.text), "")
    # one short list for each file: what its @string entries define
    macros = defined.groupBy("bibtex_file", "name").agg(F.min(plain).alias("text"))
    macros = macros.groupBy("bibtex_file").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("_macros"))
    named = parsed.filter(~F.col("_kind").isin(SKIPPED) & (F.col("_key") != "")).join(macros, "bibtex_file", "left")
    named = named.withColumn("_macros", F.coalesce("_macros", F.create_map().cast("map<string,string>")))

    def field(name: str) -> Column:
        return F.coalesce(_resolved(F.element_at("_fields", F.lit(name))), F.lit(""))

    names = ["title", "author", "institution", "year", "journal", "publisher", "keywords"]
    values = named.select(*[c for c in entries.columns if c != "entry"], F.col("_key").alias("bibtex_key"), *[field(n).alias(f"_{n}") for n in names])
    return values.select(
        "bibtex_key",
        clean_bibtex(F.col("_title")).alias("title"),
        author_names(F.col("_author")).alias("authors"),
        institutions(F.col("_institution"), F.col("_author")).alias("institutions"),
        F.col("_year").alias("year"),
        clean_bibtex(F.col("_journal")).alias("journal"),
        clean_bibtex(F.col("_publisher")).alias("publisher"),
        bibtex_keywords(F.col("_keywords"), F.col("_title")).alias("keywords"),
        *[c for c in entries.columns if c != "entry"],
    )


def failed_files(listing: DataFrame, entries: DataFrame) -> DataFrame:
    """Files of the listing (bibtex_file) from which no entry came."""
    return listing.join(entries.select("bibtex_file").distinct(), "bibtex_file", "left_anti")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def match_pdfs(papers: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Adds pdf_file and has_pdf: same file stem first, then the stem ignoring case.

    ``pdfs`` has pdf_file; several files with one stem are reduced to the first name.
    """
    named = pdfs.withColumn("_stem", _stem(F.col("pdf_file")))
    exact = named.groupBy("_stem").agg(F.min("pdf_file").alias("_exact"))
    folded = named.groupBy(F.lower("_stem").alias("_low")).agg(F.min("pdf_file").alias("_folded"))
    return (
        papers.withColumn("_stem", _stem(F.col("bibtex_file")))
        .withColumn("_low", F.lower("_stem"))
        .join(exact, "_stem", "left")
        .join(folded, "_low", "left")
        .withColumn("pdf_file", F.coalesce("_exact", "_folded"))
        .withColumn("has_pdf", F.col("pdf_file").isNotNull())
        .drop("_stem", "_low", "_exact", "_folded")
    )
