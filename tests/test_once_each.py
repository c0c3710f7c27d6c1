"""Costly steps run once for each row, and only for rows that need them."""

import random
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from scholarweave.functions import documents, node_text
from scholarweave.functions.text import truncate_words
from scholarweave.llm import filter_audit
from scholarweave.plans import graph
from scholarweave.sources import bibtex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_node_text_names_each_attribute_once(spark):
    said = str(node_text.paper_text())
    assert [said.count(c) for c in ("abstract", "keywords", "title")] == [1, 1, 1]
    rows = [(1, "A title!", " some   words ", ["Deep Nets", "x", "deep nets", "X"]), (2, None, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, abstract string, keywords array<string>")
    df = df.withColumns({"authors": F.array(F.lit("Ann")), "journal": F.lit(None).cast("string"), "year": F.lit(2020)})
    texts = {r["id"]: r["t"] for r in df.select("id", node_text.paper_text().alias("t")).collect()}
    assert texts == {1: "Title: A title Abstract: some words Keywords: Deep Nets, x Authors: Ann Year: 2020", 2: "Authors: Ann Year: 2020"}


def test_truncate_words(spark):
    df = spark.createDataFrame([(1, "a  b c"), (2, " a  b "), (3, None), (4, "")], "id int, s string")
    assert {r["id"]: r["t"] for r in df.select("id", truncate_words(F.col("s"), 2).alias("t")).collect()} == {1: "a b", 2: " a  b ", 3: None, 4: ""}


def terms(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frequent_terms_without_shuffle(spark, monkeypatch):
    words, rnd = ["alpha", "bravo", "carbon", "delta", "élan", "x1", "The"], random.Random(3)
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 30, 300])))) for i in range(60)] + [(None, "delta delta"), (100, None), (101, "solo")]
    docs = spark.createDataFrame(rows, "k int, text string")
    alone = documents.frequent_terms(docs, "k", "text", 2, 5)
    assert "Exchange" not in plan(alone)
    expected = terms(documents._terms_of_keys(docs, "k", "text", 2, 5))
    assert terms(alone) == expected
    monkeypatch.setattr(documents, "TOKENS", 50)
    assert terms(documents.frequent_terms(docs, "k", "text", 2, 5)) == expected


def test_frequent_terms_of_repeated_keys(spark):
    rows = [(1, "alpha bravo"), (1, "alpha carbon"), (None, "delta élan"), (None, "delta"), (2, "alpha alpha"), (3, "bravo")]
    docs = spark.createDataFrame(rows, "k int, text string")
    found = {(r["k"], r["term"], r["freq"]) for r in documents.frequent_terms(docs, "k", "text", 2, 5).collect()}
    assert found == {(1, "alpha", 2), (None, "delta", 2), (2, "alpha", 2)}


def test_document_keywords_join_no_texts(spark):
    docs = spark.createDataFrame([(1, "Keywords: Soc, Cells\nalpha beta alpha beta"), (2, None), (None, "gamma gamma")], "k int, t string")
    out = documents.document_keywords(docs, "k", "t")
    assert not any("_t#" in line for line in plan(out).splitlines() if "Join" in line or "Exchange" in line or "Sort " in line)
    found = {r["k"]: r["keywords"] for r in out.collect()}
    assert {"alpha", "alpha beta", "soc", "cells"} <= set(found[1]) and found[2] is None and found[None] == []


def test_bibtex_records_are_parsed_for_macros_only_if_they_may_define_one(spark):
    rows = [('@STRING{j = "A {"} B"}', "f"), ("article{k, title = {T}}, journal = j, year = {2020}", "f"), ('article{m, journal = j, title = "x } y" , year = 1}', "g"), (None, "g")]
    parsed = bibtex.parse_entries(spark.createDataFrame(rows, "entry string, bibtex_file string"))
    assert "contains(lower(entry" in plan(parsed).lower()
    assert [(r["bibtex_key"], r["title"]) for r in parsed.orderBy("bibtex_key").collect()] == [("k", "T"), ("m", 'x y" , year = 1')]


def small_tables(spark, folder):
    at = date(2020, 1, 1)
    given = {
        "nation": ([(0, "PERU"), (1, "CHAD")], "n_nationkey int, n_name string"),
        "customer": ([(1, 0, "CARS"), (2, 1, "BOOKS")], "c_custkey int, c_nationkey int, c_mktsegment string"),
        "orders": ([(i, 1 + i % 2, at, "HIGH", "O") for i in range(1, 7)], "o_orderkey int, o_custkey int, o_orderdate date, o_orderpriority string, o_orderstatus string"),
        "lineitem": ([(i, 1 + i % 3, 1 + j % 2, j) for i in range(1, 7) for j in (1, 2)], "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int"),
        "part": ([(1, "rod"), (2, "cap"), (3, "rod")], "p_partkey int, p_name string"),
        "supplier": ([(1, "Ann"), (2, "Bob")], "s_suppkey int, s_name string"),
        "documents": ([(1, "one"), (4, "four")], "doc_id int, text string"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_wanted_nodes_are_described_as_in_the_whole_graph(spark, tmp_path):
    d = small_tables(spark, tmp_path)
    wanted = spark.createDataFrame([("paper_1",), ("paper_5",), ("author_2",), ("PERU",), ("rod",), ("nobody",)], "id string")
    whole, _ = graph.described(spark, d)
    some, _ = graph.described(spark, d, wanted)
    expected = whole.join(wanted, "id", "left_semi")
    assert terms(some.select(expected.columns)) == terms(expected) and some.count() == 5


class Kept:
    def __init__(self):
        self.value, self.exists = None, False

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def test_changes_of_counters_add_up(spark):
    rnd, big = random.Random(5), (1 << 60) + 1
    rows = [(0, bytes([rnd.randrange(6)]), rnd.choice([None, big, big + 1, big + 2, big + 3, 7]), "p%d" % rnd.randrange(2), rnd.randrange(4), rnd.random() < 0.5, False, 1) for _ in range(200)]
    names = ["bucket", "sha", "id", "part", "mask", "good", "toxic", "n"]
    schema = pa.schema([("bucket", pa.int64()), ("sha", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])
    state, total = Kept(), {}
    for at in range(0, 200, 40):
        batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[at : at + 40]], schema=schema)
        summed = pa.Table.from_batches(filter_audit._sum_copies(iter([batch])))
        assert summed["id"].null_count == 0  # ids would become floats
        for out in filter_audit._update((0,), iter([summed.replace_schema_metadata(None).to_pandas()]), state):
            assert isinstance(out, pd.DataFrame)
            for *of, n in out.itertuples(index=False):
                total[tuple(of)] = total.get(tuple(of), 0) + n
    least = {}
    for _, sha, i, *_ in rows:
        if i is not None:
            least[sha] = min(i, least.get(sha, i))
    expected = {}
    for _, sha, i, part, mask, good, toxic, n in rows:
        of = (part, mask | filter_audit.DUPLICATE if i is not None and i > least[sha] else mask, good, toxic)
        expected[of] = expected.get(of, 0) + n
    assert {k: n for k, n in total.items() if n} == expected
