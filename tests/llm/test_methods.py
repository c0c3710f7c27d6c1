"""Operators against brute force, round trips and held-out labels."""

import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from verify import compare, connect  # noqa: E402

from scholarweave.llm import chat, decontaminate, html_main, langid, line_dedup, links, near_dedup, packing, quality_gam, queries, repetition, suffix_dedup
from scholarweave.llm.words import BLANKS, LOWER, NO_WORD, Words, row_buffer, slices

SF_DIR = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    cur = connect(SF_DIR).execute(queries.SQL[name])
    problem = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [c[0] for c in cur.description])
    assert problem is None, problem


def test_all_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\t\x0bé中\x85\xa0\x1cX-9") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "x" * 3000]
    column = pa.array(texts, pa.string())
    for table, pattern, low in ((BLANKS, BLANK, False), (NO_WORD, LETTER, True)):
        seen = {}
        for a, b, buf, bounds in slices(column, 100):
            words = Words(LOWER[buf] if low else buf, bounds, table)
            for i in range(a, b):
                want = pattern.findall((texts[i] or "").translate(LOWERED) if low else texts[i] or "")
                f, e = words.first[i - a], words.first[i - a + 1]
                assert words.joined(f, e).decode().split(" ") == (want or [""])
                for word, code in zip(want, words.code[f:e].tolist(), strict=True):
                    assert seen.setdefault(word, code) == code
            at, code = words.window_codes(3)
            assert len({words.joined(p, p + 3) for p in at.tolist()}) == len(set(code.tolist()))
        assert len(set(seen.values())) == len(seen)


def test_repeats():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)] + ["a " * 400, "a b " * 300 + "c d e f"]
    made = repetition.measures(pa.array(texts))
    for i, text in enumerate(texts):
        words = text.split()

        def repeated(k, words=words):
            counts = Counter(tuple(words[p : p + k]) for p in range(len(words) - k + 1))
            return [p for p in range(len(words) - k + 1) if counts[tuple(words[p : p + k])] > 1]

        longest = max((k for k in range(3, len(words)) if repeated(k)), default=0)
        assert made["longest_repeat"][i] == longest
        assert made["n_repeat_words"][i] == len({p + j for p in repeated(3) for j in range(3)})
        assert made["n_covered"][i] == len({p + j for p in repeated(repetition.LEAST) for j in range(repetition.LEAST)})


def test_substring_removal(spark):
    rng = random.Random(7)
    passages = [[f"p{k}x{i}" for i in range(rng.choice([49, 50, 51, 80, 130]))] for k in range(8)]
    rows = []
    for doc in range(60):
        words = [f"d{doc}w{i}" for i in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages)[: rng.choice([40, 50, 60, 200])] + [f"d{doc}v{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        rows.append((doc, " ".join(words)))
    rows += [(100 + d, t) for d, t in rows[:5]] + [(200, "a " * 120), (201, "a " * 60)]
    first, want = {}, {}
    for doc, text in sorted(rows):
        words = text.split()
        for p in range(len(words) - 49):
            first.setdefault(tuple(words[p : p + 50]), doc)
    for doc, text in rows:
        words, gone = text.split(), set()
        for p in range(len(words) - 49):
            if first[tuple(words[p : p + 50])] < doc:
                gone.update(range(p, p + 50))
        want[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    made = suffix_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in made:
        kept = r["kept"] if r["kept"] is not None else " ".join(texts[r["doc_id"]].split())
        assert (r["n_words"], r["n_removed"], kept) == want[r["doc_id"]]


def near_copies():
    rng = random.Random(11)
    rows, doc = [], 0
    for _ in range(12):
        base = [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"c{rng.randrange(10**6)}"
            rows.append((doc, " ".join(copy)))
            doc += 1
    rng.shuffle(rows)
    return [(i, text) for i, (_, text) in enumerate(rows)]


def brute_components(rows, k):
    sets = {}
    for doc, text in rows:
        words = BLANK.findall((text or "").translate(LOWERED))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = near_copies()
    made = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
    assert {r["doc_id"]: r["component_id"] for r in made} == brute_components(rows, k)


def test_links_across_stars(spark, monkeypatch):
    """A chain in which the first document is linked to few: the blocks inside buckets find the rest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[rng.randrange(120)] = f"n{i}"
        words[rng.randrange(120)] = f"m{i}"
    rng.shuffle(rows)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    made = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in made} == brute_components(rows, 4)


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        common = int(n * share)
        a = [f"x{i}" for i in rng.integers(0, 1 << 60, n)]
        b = a[:common] + [f"y{i}" for i in rng.integers(0, 1 << 60, n - common)]
        made = near_dedup.sketch_batch(pa.array([" ".join(a), " ".join(b), " ".join(a + b)]), 1)
        x, y, both = (np.frombuffer(r, dtype=">u2").astype(int) for r in made["registers"].to_pylist())
        true = common / (2 * n - common)
        found = near_dedup.likelihood_estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([n]), np.array([n]))[0]
        assert abs(found - true) < 0.12
        assert (near_dedup.merge(x, y) == both).all()


def test_components(spark):
    chain = [(i + 1, i) for i in range(70)] + [(200, 201), (201, 202), (5, 5)]
    made = {r["node"]: r["label"] for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert made == {i: 0 for i in range(71)} | {200: 200, 201: 200, 202: 200}


def test_line_runs(spark):
    rng = random.Random(4)
    for run in (1, 2, 3):
        rows = [(d, "\n".join(rng.choice(["a", "b ", " c", "dd", "", "e f", "g"]) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
        first, want = {}, {}
        for doc, text in rows:
            used = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
            gone = set()
            for p in range(len(used) - run + 1):
                key = tuple(x for _, x in used[p : p + run])
                if first.setdefault(key, (doc, p)) != (doc, p):
                    gone.update(i for i, _ in used[p : p + run])
            want[doc] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        made = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run).collect()
        assert {r["doc_id"]: r["text"] for r in made} == want


def test_long_lines_go_alone(spark):
    """Against brute force: a long line is a run of its own, also in a text of one line; shorter ones go in runs of two."""
    long, short, cjk = " ".join(f"w{i}" for i in range(10)), " ".join(f"w{i}" for i in range(9)), "\u96fb\u6c60" * 50
    rng = random.Random(8)
    rows = [(d, "\n".join(rng.choice([long, f" {long}\t", short, cjk, f"{d} x", "a", ""]) for _ in range(rng.randrange(1, 7)))) for d in range(40)] + [(100, long), (101, short), (102, f"p\n{cjk}\nq")]
    first, want = {}, {}
    for doc, text in rows:
        used = [(i, x.strip(" \t")) for i, x in enumerate(text.split("\n")) if x.strip(" \t")]
        gone = set()
        for run in (1, 2):
            for p in range(len(used) - run + 1):
                key = tuple(x for _, x in used[p : p + run])
                if (run == 2 or key[0] in (long, cjk)) and first.setdefault(key, (doc, p)) != (doc, p):
                    gone.update(i for i, _ in used[p : p + run])
        want[doc] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    assert want[100] == "" and want[101] == short and want[102] == "p\nq"
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(table).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["line_dedup"](spark, table, SF_DIR)
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == {d: t for d, t in want.items() if t.strip() or t == dict(rows)[d]}


def test_packing_rule():
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 4096) for _ in range(500)), reverse=True)
    made = packing.pack(sizes)
    assert sorted(i for _, m in made for i in m) == list(range(500))
    for length, members in made:
        used = sum(sizes[i] for i in members)
        assert length == min(x for x in packing.LENGTHS if x >= used)
    # plain search for the tightest room, over the same opening rule
    assert sum(sizes) / sum(length for length, _ in made) > 0.93
    assert packing.pack([5, 3, 2], (5, 10), 0) in ([(5, [0]), (5, [1, 2])], [(10, [0, 1, 2])])
    assert packing.pack([]) == []


def test_best_fit_against_plain_search():
    rng = random.Random(9)
    for _ in range(20):
        sizes = sorted((rng.randrange(1, 60) for _ in range(80)), reverse=True)
        rooms, plain = [], []
        made = packing.pack(sizes, (64,), 0)
        for i, size in enumerate(sizes):
            fitting = [(room, k) for k, room in enumerate(rooms) if room >= size]
            if fitting:
                _, k = min(fitting)
                rooms[k] -= size
                plain[k].append(i)
            else:
                rooms.append(64 - size)
                plain.append([i])
        assert [m for _, m in made] == plain


def test_packing_is_whole(spark, docs):
    counts = packing.word_counts(docs)
    made = packing.sequences(counts, shard=64)
    spans = made.select(F.explode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("s")).select("s.*")
    placed = {}
    for r in spans.collect():
        placed.setdefault(r["doc_ids"], []).append((r["starts"], r["lengths"]))
    for r in counts.collect():
        at = 0
        for start, length in sorted(placed.get(r["doc_id"], [])):
            assert start == at
            at += length
        assert at == r["n_tokens"]


def test_classifier_on_held_out_labels(spark):
    rows = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_language_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_all_segmentations_count():
    rng = random.Random(1)
    pieces = sorted({bytes([c]) for c in b" abc"} | {b"ab", b"bc", b"abc", b" a", b" ab", b"ca"})
    p = np.array([[rng.random(), rng.random()] for _ in pieces])
    model = langid.Model(["x", "y"], pieces, p)
    number = {piece: i for i, piece in enumerate(pieces)}

    def total(word, k):
        return 1.0 if not word else sum(p[number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)

    words = [b" " + bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    assert np.allclose(np.exp(model.log_words(words)), [[total(w, 0), total(w, 1)] for w in words])


def test_chat_round_trip():
    rng = random.Random(6)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "sys\ntem\\n"]), "".join(rng.choice(["<", "|", "\\", "<|im_end|>", chat.START, "\n", "a", "é"]) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(5))]
        made = chat.write([{"role": r, "parts": [{"kind": "text", "text": t}]} for r, t in turns])
        assert chat.read(made["formatted"]) == turns
        assert chat.loss_text(made["formatted"], made["loss_spans"]) == "".join(t for r, t in turns if r == "assistant")


def test_chat_parts():
    parts = [
        {"kind": "text", "text": "look <|image:0.1|> "}, {"kind": "image", "ref": "a.png", "width": 28, "height": 15}, None, {"kind": "audio", "ref": "b.wav", "seconds": 1.5},
        {"kind": "document", "ref": "c.pdf", "pages": 2},
    ]
    made = chat.write([{"role": "user", "parts": parts}])
    assert made["formatted"] == "<|im_start|>user\nlook <\\|image:0.1|> <|image:0.1|><|audio:0.2|><|document:0.3|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in made["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 2048)]
    with pytest.raises(ValueError):
        chat.write([{"role": "user", "parts": [{"kind": "video"}]}])


def test_pages_equal_their_articles(spark):
    import html

    found = {r["page_id"]: r["text"] for r in queries.op5_html_extraction(spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        assert found[r["page_id"]] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def test_pages_without_marks():
    counts = Counter()
    for page in ("<nav><a>x</a></nav><article><h1>t</h1><p>one two three<p>four</article><ul><li><a>r</a></li></ul><div><a>s</a></div>",) * 20:
        for (kind, text, _), own in zip(*html_main.tokens(page), strict=True):
            counts[kind, own] += html_main._amount(kind, text)
    weight = html_main.weights(counts)
    body = "<div class='story'><h2>Title</h2><p>Some <b>bo</b>ld words here and more of them.</p><div class='share'>share</div><p>Tail &eacute;.</p></div>"
    page = f"<header>Site</header><ul><li><a>Home</a></li><li><a>News</a></li></ul>{body}<section id='comments'><p>First!</p></section><script>x</script><form>f</form>"
    assert html_main.extract(page, weight) == "Title Some bold words here and more of them. Tail é."


@pytest.mark.parametrize("opening", [
    "div class='overflow-hidden'", "div style='overflow:hidden'", "div class='hidden-xs'", "div aria-hidden='false'", "div data-hidden=1", "div style='x-display:none'",
    "div class='article-header'", "section id='related-work'", "div class='search-results-analysis'", "div class='legal'", "div data-id='ad'",
])
def test_elements_of_an_article_stay(opening):
    name = opening.split()[0]
    for page in (f"<article><p>one two</p><{opening}><p>three four</p></{name}></article>", f"<{opening}><article><p>one two</p><p>three four</p></article></{name}>"):
        assert html_main.extract(page, {"w": 3.0, "div": -0.1, "/div": -0.1, "section": -0.1, "/section": -0.1}) == "one two three four"
    if "'legal'" not in opening:  # as a whole name it is excluded where no mark says otherwise
        assert html_main.extract(f"<{opening}><p>three four</p></{name}>", {"w": 3.0}) == "three four"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; Display : none !important'", "class='big ad'", "id=comments", "class='cookie'"])
def test_hidden_and_advert_elements_go(attributes):
    for around in ("article", "div"):
        assert html_main.extract(f"<{around}><p>one two</p><div {attributes}>three</div><p>four five</p></{around}>", {"w": 3.0}) == "one two four five"


def test_best_stretch():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(1, 15))]
        a, b = html_main.best_stretch(scores)
        assert sum(scores[a:b]) == max(0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))


def test_pipeline_stages(spark, docs, tmp_path):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept, SF_DIR)
        if name == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in queries.op1_quality_classifier(spark, SF_DIR).collect()}
            assert {r["doc_id"] for r in made.collect()} == {d for d, p in scores.items() if p}
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(kept).collect()}
            before = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert {r["doc_id"]: r["text"] for r in made.collect()} == {d: t for d, t in texts.items() if t.strip() or t == before[d]}
        if name == "near_dedup":
            groups = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()], corpus_pipeline.SHINGLE)
            assert {r["doc_id"] for r in made.collect()} == {d for d, c in groups.items() if d == c}
        if name == "decontamination":
            windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() for w in [LETTER.findall(r["text"].translate(LOWERED))] for i in range(max(1, len(w) - 9))}
            dirty = set()
            for r in kept.collect():
                w = LETTER.findall(r["text"].translate(LOWERED))
                if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
                    dirty.add(r["doc_id"])
            assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in kept.collect()} - dirty
        if name == "packing":
            assert sum(sum(r["lengths"]) for r in made.collect()) == sum(len(BLANK.findall(r["text"])) for r in kept.collect())
            break
        made.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns


def test_joins_agree_at_every_size(spark, monkeypatch):
    from scholarweave.llm import common

    large = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    small = spark.createDataFrame([(3, [1, 2]), (5, []), (99, [7])], "doc_id long, shared array<long>")
    found = []
    for bound in (1 << 26, 2 * 64 * 3, 0):  # lists shipped, ids shipped, both sides shuffled
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        found.append(sorted(map(str, common.join_lists(large, small, "doc_id", "shared", 8).collect())))
        assert sorted(r["doc_id"] for r in common.join_sized(large, small, "doc_id", "left_semi", 64).collect()) == [3, 5]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2
