"""Text helpers, fuzzy matching, chunks, context budget, files."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scholarweave.functions import answers, documents, encoding
from scholarweave.functions import text as tx
from scholarweave.operators import context, fuzzy
from scholarweave.sources import bibtex, files, writers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("o")).first()[0]


def test_cleaning(spark):
    assert one(spark, "{Deep}  {Learning}\n x", tx.clean_bibtex) == "Deep Learning x"
    assert one(spark, "Müller, 김철수!", tx.clean_node_text) == "Müller, 김철수"
    assert one(spark, "Smith, John", tx.clean_author) == "John Smith"
    assert one(spark, "42", tx.clean_author) is None
    assert one(spark, "appl. energy", tx.normalize_journal) == "Applied Energy"
    assert one(spark, "  the ", tx.clean_keyword) is None and one(spark, " Battery ", tx.clean_keyword) == "battery"
    assert one(spark, "a<b & 'c'", tx.xml_safe) == "a&lt;b &amp; &apos;c&apos;"


@pytest.mark.parametrize(
    "text,length",
    [
        ("Abstract\n" + "word " * 20 + "\n\nKeywords: x", 99), ("ABSTRACT: " + "word " * 20 + "\n\nIntroduction", 99),
        ("Abstract - " + "word " * 20 + "\n\nKeywords", 99), ("Abstract\ntoo short\n\nKeywords", 0), ("nothing here", 0),
        ("Abstract\n" + "word " * 900 + "\n\nKeywords", 0),
    ],
)
def test_abstract(spark, text, length):
    df = spark.createDataFrame([(text,)], "t string")
    assert len(documents.with_abstract(df, "t").first()["abstract"]) == length


def test_references(spark):
    text = 'x\nReferences\n[1] John Smith. "A quoted title here" 2019.\n[2] Miller wrote. An unquoted title of some length 2021.\n[3] short\nAppendix\n[4] not this one at all 2020'
    rows = documents.references(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    got = rows.select(documents.reference_info(F.col("reference")).alias("i")).select("i.title", "i.year").collect()
    assert [tuple(r) for r in got] == [("A quoted title here", "2019"), ("An unquoted title of some length", "2021")]


def best_match(title, year, papers):
    best, found = 0.0, None
    for pid, name in papers:
        a, b = title.lower().strip(), name.lower().strip()
        score = SequenceMatcher(None, a, b).ratio() + (0.3 if a in b or b in a else 0) + (0.1 if year and year in name else 0)
        if score > best and score > 0.7:
            best, found = score, pid
    return found


@pytest.mark.parametrize("block", [2, 2000])
def test_fuzzy_matching_equals_brute_force(spark, block):
    papers = [(0, "A survey of battery ageing models"), (1, "A survey of battery aging models 2019"), (2, "Deep learning for charge estimation"), (3, "A survey of battery ageing models"), (4, "Graph retrieval")]
    refs = [("r0", "a survey of battery ageing models", ""), ("r1", "A survey of battery ageing models", "2019"), ("r2", "Deep learnin for charge estimations", "2020"), ("r3", "short", ""), ("r4", "something else entirely", ""), ("r5", "graph retrieval at scale", "")]
    out = fuzzy.match_references(spark.createDataFrame(refs, "ref_id string, title string, year string"), spark.createDataFrame(papers, "paper_id long, title string"), block).collect()
    got = {r["ref_id"]: int(r["paper_id"]) for r in out}
    want = {r: best_match(t, y, papers) for r, t, y in refs if len(t) >= 10}
    assert got == {r: p for r, p in want.items() if p is not None}


def test_chunks_cover_and_overlap():
    text = "\n\n".join(" ".join(f"w{i}-{j}" for j in range(60)) for i in range(8))
    pieces = encoding.chunk(text, 300, 60)
    assert all(len(p) <= 300 for p in pieces) and all(w in " ".join(pieces) for w in text.split())
    assert encoding.chunk("short", 300, 60) == ["short"] and encoding.chunk("x" * 700, 300, 60)[0] == "x" * 300


def test_failed_texts_give_null(spark):
    def make():
        def model(texts):
            if "bad" in texts:
                raise ValueError("bad")
            return [[1.0, 0.0] for _ in texts]

        return model

    df = spark.createDataFrame([("ok",), ("bad",), ("fine",)], "t string").coalesce(1)
    out = df.select("t", encoding.encode(F.col("t"), make).alias("v")).collect()
    assert {r["t"]: r["v"] is None for r in out} == {"ok": False, "bad": True, "fine": False}


def test_answers(spark):
    assert one(spark, "aaaaaaaab yes yes yes no", answers.clean_answer) == "ab yes no"
    assert one(spark, "!!!", answers.is_meaningless) and not one(spark, "This is a perfectly good answer.", answers.is_meaningless)


def test_budget_stops_at_first_overflow(spark):
    rows = [("q", "overview", "a" * 400), ("q", "papers", "# Papers\n" + "\n".join("d" * 40 for _ in range(100))), ("q", "authors", "b" * 40)]
    out = {r["section"]: r["text"] for r in context.fit_budget(spark.createDataFrame(rows, "query_id string, section string, text string"), 300).collect()}
    assert set(out) == {"overview", "papers"} and out["papers"].endswith(context.TRUNCATED) and len(out["papers"]) // 4 <= 215


def test_bibtex_file(spark, tmp_path):
    (tmp_path / "one.txt").write_text(
        '@string{x = "y"}\n@article{k1,\n title = {A {Deep {Learning}} study},\n author={Smith, John and Mary Jones and KAIST Institute},\n year=2019,\n journal="Appl. Energy",\n keywords={battery; AI, ev charging}\n}\n@book{k2, title={No authors}}\n'
    )
    (tmp_path / "bad.txt").write_text("nothing to parse")
    raw = bibtex.read_entries(spark, str(tmp_path))
    rows = {r["bibtex_key"]: r for r in bibtex.parse_entries(raw).collect()}
    assert set(rows) == {"k1", "k2"} and rows["k1"]["title"] == "A Deep Learning study"
    assert rows["k1"]["authors"] == ["John Smith", "Mary Jones", "KAIST Institute"] and rows["k1"]["year"] == "2019"
    assert rows["k1"]["keywords"] == ["battery", "ev charging", "deep learning"] and rows["k2"]["authors"] == []
    listing = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("bibtex_file"))
    assert [r[0].rsplit("/", 1)[1] for r in bibtex.failed_files(listing, raw).collect()] == ["bad.txt"]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "paper", ["x", "y"]), ("b", "author", [])], "id string, node_type string, keywords array<string>")
    edges = spark.createDataFrame([("a", "b", "cites", 0.5)], "src string, dst string, edge_type string, weight double")
    writers.write_graph(nodes, edges, f"{tmp_path}/g", ["keywords"])
    found, missing = files.read_graphs(spark, str(tmp_path), ["g", "h"])
    assert missing == ["h"] and found["g"][0].count() == 2 and found["g"][1].first()["weight"] == 0.5
    writers.write_graphml(nodes, edges, f"{tmp_path}/ml")
    import xml.etree.ElementTree as ET
    from pathlib import Path

    text = "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/ml").glob("part-*")))
    assert len(ET.fromstring(text).findall(".//{*}node")) == 2


def test_questions_file_and_pdfs(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# c\n\n what is it \nwho\n")
    assert sorted(r[0] for r in files.read_questions(spark, f"{tmp_path}/q.txt").collect()) == ["what is it", "who"]
    (tmp_path / "a.pdf").write_bytes(b"hello")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    out = files.read_pdf_texts(spark, str(tmp_path), extract=lambda c, n: c.decode())
    assert sorted(r["text"] for r in out.collect()) == ["", "hello"]


def test_store_layouts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "paper", [1.0, 0.0])], "node_id string, node_type string, embedding array<float>")
    writers.write_store(rows, str(tmp_path), "flat")
    assert files.find_store(spark, str(tmp_path)) == "flat"
    writers.write_store(files.read_embeddings(spark, f"{tmp_path}/flat"), str(tmp_path))
    assert files.find_store(spark, str(tmp_path)) == "partitioned"


def test_author_names_keep_braces_of_any_depth(spark):
    from scholarweave.functions.documents import author_names

    rows = [
        ("Smith, John and Mary Jones AND {Barnes and Noble}", ["John Smith", "Mary Jones", "Barnes and Noble"]),
        ("{{{A and {B and {C}}} and D} Group} and Lee, Ann", ["A and B and C and D Group", "Ann Lee"]),
        ("{open and Lee, Ann", ["Ann open and Lee"]), ("", []), (None, []),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "a string").select(author_names(F.col("a")).alias("n"))
    assert [r["n"] for r in df.collect()] == [r[1] for r in rows]
