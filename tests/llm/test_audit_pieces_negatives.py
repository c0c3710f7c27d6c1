"""Filter audit, SentencePiece and hard negatives against brute force; pages with broken markup; columns of any name."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from scholarweave.llm import filter_audit, hard_negatives, html_main, pieces, quality_gam

MODEL_PATH = public_tokenizers.path("piece_bpe_32k.model")


def audit_by_hand(docs, labels):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = []
        for i, text, p in docs:
            if (p or "") != part:
                continue
            t = text or ""
            w = words(t)
            fails = ("A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
                     + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least[t]))
            rows.append((fails, i in good, i in toxic))
        shapley = Counter()
        per = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], order[: step - 1]
                gone = [r for r in rows if f in r[0] and not set(before) & set(r[0])]
                shapley[f] += len(gone)
                per[order, step] = (sum(not set(order[:step]) & set(r[0]) for r in rows), len(gone), sum(f in r[0] and bool(set(before) & set(r[0])) for r in rows),
                                    sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
        out |= {(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in per.items()}
    return out


def run_audit(spark, docs, labels, path, files=5):
    """Files in falling order of ids, so that later batches bring smaller ids."""
    schema = "doc_id long, text string, lang string"
    ordered = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for n in range(files):
        part = ordered[n * len(ordered) // files : (n + 1) * len(ordered) // files]
        spark.createDataFrame(part, schema).coalesce(1).withColumn("mask", F.lit("x")).write.mode("append").parquet(path)
    known = spark.createDataFrame(labels, "id long, quality int, toxic int")
    counted = filter_audit.counters(spark, path, known, {"id": "doc_id", "part": "lang", "text": "text"})
    return counted, filter_audit.audit(counted)


def test_audit_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "BETA", "ga#mma", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([5, 120, 150]))) for _ in range(12)] + ["", None, "A"]
    docs = [(rng.randrange(300), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(90)] + [(None, texts[0], "en"), (None, None, None)]
    docs += docs[:6]  # repeated rows
    docs += [(i, "the same text for a third of all", "fr") for i in range(400, 440)]
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1), (7, 1, 0), (7, 0, 1)]
    counted, made = run_audit(spark, docs, labels, str(tmp_path / "docs.parquet"))
    assert counted.filter("n < 0").isEmpty() and counted.agg(F.sum("n")).first()[0] == len(docs)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in made.collect()}
    assert found == audit_by_hand(docs, labels)


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    labels = spark.createDataFrame([], "id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.counters(spark, path, labels, {"id": "doc_id", "part": "lang", "text": "text"})).count() == 0


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "Hello world, hello  World!\n\n new\tline ", "▁", "a▁b ▁ c", "x\x00y", "é中文 text 🙂 12345", "1 22 333 4444", "<s> </s> <unk> <0x0A>",
    "y" * 5000, "word " * 3000, " ".join(f"w{i}" for i in range(3000)), "don't (stop) ## ;\r\n", "   wide　space",
]


@pytest.mark.parametrize("settings", [pieces.Settings(), pieces.Settings(shipped=3, long=4, held=7, part=50)])
def test_pieces_equal_the_library(spark, settings):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    model = pieces.read_model(MODEL_PATH)
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(1, "a  b", "x", "y"), (None, "no id here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` string").repartition(3)
    made = pieces.decode(pieces.encode(docs, model, ["doc_id", "text", "a.b"], settings), model, ["doc_id", "text", "ids", "a.b"], settings).collect()
    assert len(made) == len(rows)
    for r in made:
        want = sp.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == (sp.decode(want) if want else "")
    assert pieces.encode(docs.filter("false"), model, ["doc_id"], settings).count() == 0


def test_pieces_refuse_other_models():
    with pytest.raises(Exception):
        pieces.Model(b"no model")


def negatives_by_hand(rows, settings):
    """``rows``: (id, label, vector)."""
    clean = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)}
    clean = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in clean]
    out = []
    for i, l, v in clean:
        if i % 50:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in clean if j != i]
        for s, j, _ in sorted((x for x in score if x[2] == l), key=lambda x: (-x[0], x[1]))[: settings.positives]:
            inside = sorted((x for x in score if x[2] != l and settings.low * s <= 100 * x[0] <= settings.high * s), key=lambda x: (-x[0], x[1]))
            out += [(i, j, rank, n, s, t) for rank, (t, n, _) in enumerate(inside[: settings.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"anchors": 2, "rows": 17, "tile": 7}])
def test_negatives_equal_brute_force(spark, sizes):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.uniform(-0.2, 1) for _ in range(9)]) for i in range(160)]
    rows += [(200 + i, rng.randrange(3), [0.5] * 9) for i in range(60)]  # one very common vector
    rows += [rows[0], rows[50], (50, 1, [1.0] * 9), (300, 9, [0.1] * 9), (350, 0, [0.0] * 9), (400, 1, None), (450, None, [0.1] * 9), (None, 1, [0.1] * 9), (500, 1, [0.1, None] * 4 + [0.1]), (550, 1, [float("nan")] * 9), (600, 1, [float("inf")] * 9)]
    settings = hard_negatives.Settings(**sizes)
    given = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, v array<float>, rank string")
    given = given.withColumn("label", F.expr("if(id % 7 = 0, (label + 1) % 10, label)"))
    made = hard_negatives.mine(hard_negatives.integers(given), F.col("id") % 50 == 0, settings).collect()
    exact = [(i, l, None if v is None else [r["v"][k] for k in range(len(v))]) for (i, l, v), r in zip(rows, given.select("v").collect())]
    assert sorted(tuple(r) for r in made) == negatives_by_hand(exact, settings) and made
    assert hard_negatives.mine(hard_negatives.integers(given.filter("false")), F.col("id") % 50 == 0).count() == 0


def test_negatives_refuse_scores_that_do_not_fit(spark):
    given = spark.createDataFrame([(50, 1, [1e15, 1e15]), (51, 1, [1e15, 1e15])], "id long, label int, v array<double>")
    with pytest.raises(Exception):
        hard_negatives.mine(hard_negatives.integers(given), F.col("id") % 50 == 0).collect()


PAGES = {
    '<article><p class="a"">one two</p></article>': "one two",
    "<article><p data-x=it's>one two</p><p>three</p></article>": "one two three",
    '<form id="aspnetForm"><p>one two three</p></form>': "one two three",
    '<div id="search"><article>one two</article></div>': "one two",
    '<article><p>one two three four</p><div class="comment-list"><p>bad</p></div><article class="user-post"><p>worse</p></article></article>': "one two three four",
    "<article>one two three</article><p>between</p><article>four five six</article>": "one two three four five six",
    "<article><p>let <math><mi>y</mi></math> be</p></article>": "let y be",
    "<nav><a>menu</a></nav><div class='ad'>buy this</div><div><h1>Title</h1><p>one two three.</p></div><footer>all rights</footer>": "Title one two three.",
}


def test_broken_and_wrapped_pages():
    counts = Counter()
    page = "<nav><ul><li><a>a b</a></ul></nav><div class='ad'>c d</div><article><h1>t</h1><p>one two three<p>four</article><footer>e</footer>"
    for (kind, text, _), own in zip(*html_main.tokens(page), strict=True):
        counts[kind, own] += html_main._amount(kind, text) * 20
    weight = html_main.weights(counts)
    assert weight["z-never"] < 0 < weight["w"]
    for html, want in PAGES.items():
        assert html_main.extract(html, weight) == want, html
    assert html_main.extract("<div>" * 20_000 + "<article>a b</article>" + "</div>" * 20_000, weight) == "a b"


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some text", "x", "y")], "doc_id long, text string, `a.b` string, `c``d` string")
    made = quality_gam.score(docs, quality_gam.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert {"a.b", "c`d"} <= set(made.columns) and made.count() == 1


def test_ids_are_packed_and_batches_sliced():
    import numpy as np
    import pyarrow as pa

    from scholarweave.llm.common import slices

    lists = [[], [5], [70000, 1, 31999]]
    made = list(pieces.packed(lists))
    assert [np.frombuffer(b, np.int32).tolist() for b in made] == lists and len(made[2]) == 12
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 300, None, "", "b" * 40, "c" * 900] * 7), pa.array(range(35))], ["text", "n"])
    parts = list(slices(batch, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 10
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts) and [p.num_rows for p in slices(batch.slice(0, 0), 10)] == [0]
