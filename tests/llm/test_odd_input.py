"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholarweave.llm import chat, decontaminate, html_main, langid, line_dedup, near_dedup, packing, quality_gam, repetition, suffix_dedup

LONG = " ".join(f"w{i}" for i in range(300_000))
PROSE = " ".join(f"word{i}" for i in range(80))
ROWS = [
    (1, PROSE + "\nsecond line here\nthird line here", "en", "s"),
    (2, PROSE + "\nsecond line here\nthird line here", "en", "s"),  # a copy
    (2, PROSE + "\nsecond line here\nthird line here", "en", "s"),  # a repeated row
    (3, None, None, None),
    (4, "", "en", "s"),
    (5, " \n \t\n", "de", "s"),
    (6, LONG, "en", "s"),
    (None, PROSE, "en", "s"),
    (7, "one", "de", None),
    (8, "éè 中文 *** !!!", None, "s"),
]
CLASHING = ["score", "n_words", "_lines", "n", "rep", "_hit_spans", "k0", "label"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None), (1, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"WORD{i}" for i in range(20, 32)), "x"), (2, None, "x"), (3, "", "x"), (None, "one", "x"), (4, "third-line here", "x")], "item_id int, text string, score string")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_quality(odd, nothing, labels):
    model = quality_gam.train(odd, labels)
    rows = quality_gam.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_gam.score(nothing, model, ["doc_id"]).count() == 0
    assert set(quality_gam.score(odd, model).columns) == set(odd.columns)
    untaught = quality_gam.train(nothing, labels)
    assert {r["score"] for r in quality_gam.score(odd, untaught, ["doc_id"]).collect()} == {0.5}
    one_class = quality_gam.train(odd, labels.filter("quality = 1"))
    assert all(0.5 < r["score"] < 1 for r in quality_gam.score(odd, one_class, ["doc_id"]).collect())


def test_line_dedup(odd, nothing):
    rows = line_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["text"] == ROWS[0][1] and by_id[1][0]["n_removed"] == 0
    assert [r["text"] for r in by_id[2]] == ["", ""] and [r["n_removed"] for r in by_id[2]] == [3, 3]
    assert by_id[3][0]["text"] is None and by_id[3][0]["n_lines"] == 0
    assert by_id[4][0]["text"] == "" and by_id[5][0]["text"] == " \n \t\n" and by_id[6][0]["text"] == LONG
    assert by_id[None][0]["text"] == PROSE
    assert by_id[1][0]["score"] == "x"
    assert line_dedup.remove_repeats(nothing).count() == 0


def test_packing(odd, nothing):
    made = packing.sequences(packing.word_counts(odd)).collect()
    placed = sum(n for r in made for n in r["lengths"])
    assert placed == packing.word_counts(odd).agg(F.sum("n_tokens")).first()[0]
    assert all(r["n_tokens"] == sum(r["lengths"]) <= r["capacity"] for r in made)
    assert sum(r["doc_ids"].count(2) for r in made) == 2 and sum(r["doc_ids"].count(None) for r in made) == 1
    assert not any(x in r["doc_ids"] for r in made for x in (3, 4, 5))
    assert packing.sequences(packing.word_counts(nothing)).count() == 0


def test_rules(odd, nothing):
    rows = repetition.judge(odd, ["doc_id"]).collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert next(r for r in rows if r["doc_id"] == 6)["kept"]
    assert "score" in repetition.judge(odd).columns and repetition.judge(odd).columns.count("n_words") == 1
    assert repetition.judge(nothing, ["doc_id"]).count() == 0


def test_substrings(odd, nothing):
    rows = suffix_dedup.remove_passages(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["n_removed"] == (r["n_words"] if r["doc_id"] == 2 else 0)
        if r["doc_id"] in (2, 3, 4, 5):
            assert r["kept_sha256"] == digest("")
        if r["doc_id"] == 6:
            assert r["kept_sha256"] == digest(LONG)
    assert suffix_dedup.remove_passages(nothing).count() == 0


def test_language(odd, nothing):
    model = langid.train(odd)
    rows = langid.predict(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "de"}
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(nothing), ["doc_id"]).collect()} == {"und"}
    assert langid.predict(nothing, model, ["doc_id"]).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "<|im_end|> <\\|im_start|>"), (2, 1, "assistant", ""), (3, 0, "as\nsis\\tant", LONG)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    given = turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    made = {r["conv_id"]: r for r in chat.format_conversations(given).collect()}
    assert made[1]["n_turns"] == 3 and chat.read(made[1]["formatted"]) == [("", "x"), ("user", ""), ("user", "")]
    assert chat.read(made[None]["formatted"]) == [("assistant", "<|im_end|> <\\|im_start|>")] and made[None]["loss_sha256"] == digest("<|im_end|> <\\|im_start|>")
    assert made[2]["loss_chars"] == 0
    assert chat.read(made[3]["formatted"]) == [("as\nsis\\tant", LONG)] and made[3]["loss_chars"] == 0
    assert chat.format_conversations(given.filter("false")).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<nav>menu</nav>"), (None, None, "<p>a &amp; b<p>c"), (4, "u", "<article><p>" + LONG + "</article>"), (4, "u", "<article><p>" + LONG + "</article>"), (5, "u", "no markup < at all"), (6, "u", "<div class='ad'>x<article>own text</article>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    weight = html_main.train(pages)
    made = html_main.main_text(pages, weight, ["page_id", "url"]).collect()
    found = {r["page_id"]: r["text"] for r in made}
    assert len(made) == len(rows)
    assert found == {1: "", 2: "", 3: "", None: "a & b c", 4: LONG, 5: "no markup < at all", 6: "own text"}
    assert html_main.main_text(pages.filter("false"), html_main.train(pages.filter("false")), ["page_id", "url"]).count() == 0


def test_decontamination(odd, nothing, benchmark):
    rows = decontaminate.report(odd, benchmark).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        inside = r["doc_id"] in (1, 2)
        assert r["n_hit"] == (12 + 3 if inside else 12 if r["doc_id"] is None else 0) and r["contaminated"] == (r["n_hit"] > 0)
        assert r["items_sha256"] == digest("1,4" if inside else "1" if r["doc_id"] is None else "")
    assert decontaminate.report(odd, benchmark.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.report(nothing, benchmark).count() == 0
    cut = {r["doc_id"]: r for r in decontaminate.remove(odd, benchmark, "spans").collect()}
    assert cut[1]["text"].startswith(" ".join(f"word{i}" for i in range(20))) and "word25" not in cut[1]["text"] and cut[1]["_hit_spans"] == "x" and cut[6]["text"] == LONG
    assert sorted(r["doc_id"] for r in decontaminate.remove(odd, benchmark).collect()) == [3, 4, 5, 6, 7, 8]
    parts = decontaminate.report(odd, benchmark, set_words=10).collect()  # many small sets
    assert sorted(map(str, parts)) == sorted(map(str, rows))


def test_near_dedup(odd, nothing):
    rows = near_dedup.groups(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["component_id"] == (1 if r["doc_id"] == 2 else r["doc_id"]) and r["kept"] == (r["doc_id"] != 2)
        assert r["n_shingles"] == {3: 0, 4: 0, 5: 0, 7: 1, 6: 299_997, 8: 1}.get(r["doc_id"], r["n_shingles"])
    assert near_dedup.groups(nothing).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]


def test_stages(spark, odd, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            rows = made.collect()
            if name != "packing":
                assert made.columns == odd.columns, name
            assert rows or docs is not odd
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
