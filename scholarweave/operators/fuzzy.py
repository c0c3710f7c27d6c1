"""Matching references to papers: equal, contained and similar titles.

A reference scores ratio + 0.3 (one title contains the other) + 0.1 (its year occurs
in the title) and takes the best paper above 0.7. Equal titles and year hits are
found by equality joins; what is left is compared block against block, where a bound
on common letters rejects nearly all pairs before the exact ratio is computed.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.functions.text import strip, words
from scholarweave.operators.ranking import group_rank
from scholarweave.session import durable

BLOCK = 2000
THRESHOLD = 0.7
MIN_TITLE = 10
MATCH = "title string, year string, position long, paper_id string, similarity double"


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of 32 letter classes per text; equal characters always share a class."""
    out = np.zeros((len(texts), 32), dtype=np.int32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        np.add.at(out[row], codes % 32, 1)
    return out


def best_in_cell(refs: pd.DataFrame, titles: pd.DataFrame, with_year: bool) -> pd.DataFrame:
    """Best title above the threshold for each reference of one cell."""
    hits = []
    if len(refs) and len(titles):
        names, places = titles["title"].tolist(), titles["position"].tolist()
        ids, counts = titles["paper_id"].tolist(), letter_counts(titles["title"].tolist())
        sizes = counts.sum(axis=1)
        order = np.argsort(places, kind="stable")
        own = letter_counts(refs["title"].tolist())
        for i, (ref, year) in enumerate(zip(refs["title"], refs["year"])):
            common = np.minimum(counts, own[i]).sum(axis=1)
            bound = 2.0 * common / (sizes + len(ref))
            contained = common >= np.minimum(sizes, len(ref))
            bound = bound + 0.3 * contained + (0.1 if with_year else 0.0)
            best, found = THRESHOLD, None
            for j in order:
                if bound[j] <= best:
                    continue
                score = SequenceMatcher(None, ref, names[j]).ratio()
                if ref in names[j] or names[j] in ref:
                    score += 0.3
                if with_year:
                    score += 0.1
                if score > best:
                    best, found = score, j
            if found is not None:
                hits.append((ref, year, places[found], ids[found], best))
    return pd.DataFrame(hits, columns=["title", "year", "position", "paper_id", "similarity"])


def _blocks(df: DataFrame, name: str, block: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // block))
    return df.withColumn(name, F.pmod(F.xxhash64("title"), F.lit(n)).cast("int")), n


def _compare(refs: DataFrame, titles: DataFrame, keys: list[str], with_year: bool, block: int) -> DataFrame:
    """Every reference against every title with equal ``keys``, one bounded cell at a time."""
    left, n_left = _blocks(refs, "_r", block)
    right, n_right = _blocks(titles, "_t", block)
    cells = ["_r", "_t", *keys]
    left = left.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    matched = left.groupBy(*cells).cogroup(right.groupBy(*cells))
    return matched.applyInPandas(lambda a, b: best_in_cell(a, b, with_year), MATCH)


def match_references(refs: DataFrame, papers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ref_id, paper_id, similarity) of each reference that finds a paper.

    ``refs`` has ref_id, title, year; ``papers`` has paper_id, title and optionally
    position (paper order, decides ties). Equal titles are compared once.
    """
    if "position" not in papers.columns:  # ids of any type: in the order of their type, counted from 1
        papers = group_rank(papers.select("paper_id", "title"), [], ["paper_id"], "position")
    titles = (
        papers.select(strip(F.lower("title")).alias("title"), "position", F.col("paper_id").cast("string").alias("paper_id"))
        .groupBy("title")
        .agg(F.min("position").alias("position"), F.min_by("paper_id", "position").alias("paper_id"))
    )
    cleaned = refs.select("ref_id", strip(F.lower("title")).alias("title"), F.coalesce("year", F.lit("")).alias("year"))
    cleaned = durable(cleaned)  # extraction is costly and read by every way of matching
    wanted = cleaned.filter(F.length("title") >= MIN_TITLE).select("title", "year").distinct()

    year_in_title = (F.col("year") != "") & F.contains(F.col("title"), F.col("year"))
    equal = wanted.join(titles, "title").withColumn("similarity", F.lit(1.3) + F.when(year_in_title, 0.1).otherwise(0.0))
    # A title that contains the reference's year: found by equality on the year.
    years = F.array_distinct(
        F.filter(
            F.transform(F.sequence(F.lit(1), F.length("title")), lambda i: F.substr("title", i, F.lit(4))),
            lambda y: y.rlike("^20[0-2][0-9]$"),
        )
    )
    dated = titles.withColumn("year", F.explode(years))
    by_year = _compare(wanted.filter("year <> ''"), dated, ["year"], True, block)
    # Without the year nothing beats an equal title, so only the rest is compared.
    open_refs = wanted.join(titles.select("title"), "title", "left_anti")
    similar = _compare(open_refs, titles, [], False, block)

    found = equal.select("title", "year", "position", "paper_id", "similarity").unionByName(by_year).unionByName(similar)
    best = found.groupBy("title", "year").agg(
        F.max_by(F.struct("paper_id", "similarity"), F.struct(F.col("similarity"), -F.col("position"))).alias("m")
    )
    return cleaned.join(best, ["title", "year"]).select("ref_id", "m.paper_id", "m.similarity")


def _grams(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, _anchor): the distinct runs of ``n`` characters of each text."""
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substr("text", i, F.lit(n)))
    return docs.filter(F.length("text") >= n).select("doc_id", F.explode(F.array_distinct(grams)).alias("_anchor"))


def containment(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document contains the whole passage.

    A passage of three words or more is looked up by its longest inner word, which
    must be a word of the document; a shorter one by its first three characters, or by
    all it has. An empty passage is contained in nothing.
    """
    inner = F.slice(words(F.col("passage")), F.lit(2), F.greatest(F.size(words(F.col("passage"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = passages.withColumn("_anchor", longest)
    tokens = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("_anchor"))
    candidates = tokens.join(keyed.filter(F.col("_anchor").isNotNull()).select("item_id", "_anchor"), "_anchor")
    short = keyed.filter(F.col("_anchor").isNull()).select("item_id", F.substring("passage", 1, 3).alias("_anchor")).filter("_anchor <> ''")
    for row in short.select(F.length("_anchor").alias("n")).distinct().collect():  # three rows at most
        spans = _grams(docs, row["n"])
        candidates = candidates.unionByName(spans.join(short.filter(F.length("_anchor") == row["n"]), "_anchor"))
    checked = candidates.select("doc_id", "item_id").distinct().join(docs.select("doc_id", "text"), "doc_id").join(passages, "item_id")
    return checked.filter(F.contains(F.col("text"), F.col("passage"))).select("doc_id", "item_id")
