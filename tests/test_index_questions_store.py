"""Stored tables, communities, inverted lists, routed questions and kept vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarweave.functions import encoding
from scholarweave.operators import centrality, communities, embedding_store, ivf, question_path
from scholarweave.session import durable, forget


def test_estimates_stay_bounded_over_sixty_rounds(spark):
    df = spark.range(50).select("id", F.lit(1).alias("x"))
    for _ in range(60):
        before, df = df, durable(df.join(df.select("id", F.col("x").alias("y")), "id").select("id", ((F.col("x") + F.col("y")) % 7).alias("x")))
        forget(before)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 1 << 20 and df.count() == 50
    assert before.inputFiles() == [] or not any(f.startswith("x") for f in before.inputFiles())


def modularity_by_hand(pairs, label):
    m, degree, inside = len(pairs), {}, 0
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        inside += label[a] == label[b]
    total = {}
    for node, k in degree.items():
        total[label[node]] = total.get(label[node], 0) + k
    return inside / m - sum((t / (2 * m)) ** 2 for t in total.values())


def louvain_by_hand(pairs):
    """Single moves one after another until none helps, on the plain graph."""
    label = {x: x for p in pairs for x in p}
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    changed = True
    while changed:
        changed = False
        for node in sorted(label):
            best = max({label[x] for x in around[node]} | {label[node]}, key=lambda c: (round(modularity_by_hand(pairs, label | {node: c}), 12), c == label[node]))
            changed |= best != label[node]
            label[node] = best
    return modularity_by_hand(pairs, label)


def test_communities_against_single_moves(spark):
    rng = random.Random(2)
    pairs = sorted({(min(a, b), max(a, b)) for g in range(3) for a, b in ((rng.randrange(g * 8, g * 8 + 8), rng.randrange(g * 8, g * 8 + 8)) for _ in range(30)) if a != b} | {(0, 8), (9, 17), (1, 20)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.range(25).select("id")
    found = durable(communities.communities(nodes, edges))
    label = {r["id"]: r["community"] for r in found.collect()}
    assert len(label) == 25 and label[24] == 24
    value = modularity_by_hand(pairs, label)
    assert value >= louvain_by_hand(pairs) - 0.01
    assert abs(value - communities.modularity(communities._weighted(edges), found)) < 1e-9
    assert communities.single_moves(edges, found).filter("gain > 1e-12").isEmpty()
    assert communities.communities(nodes, edges.filter("false")).filter("id <> community").isEmpty()


def test_moves_of_a_cell_are_made_one_after_another(spark, monkeypatch):
    """Cells of few neighbours: every round raises modularity, and few rounds reach the end."""
    rng = random.Random(5)
    pairs = sorted({(min(a, b), max(a, b)) for a in range(90) for b in (rng.randrange(90), a // 9 * 9 + rng.randrange(9), a // 9 * 9 + rng.randrange(9)) if a != b})
    edges, nodes, seen = spark.createDataFrame(pairs, "src long, dst long"), spark.range(90).select("id"), []
    made = communities._one_by_one

    def listened(wanted, cells, two_m, least):
        out = durable(made(wanted, cells, two_m, least))
        first = {r["id"]: r["own"] for r in wanted.collect()}
        seen.append((cells, out.count()))
        assert all(first[r["id"]] != r["to"] for r in out.collect())
        return out

    monkeypatch.setattr(communities, "_one_by_one", listened)
    monkeypatch.setattr(communities, "LISTED", 128)
    monkeypatch.setattr(communities, "HUB", 12)
    found = durable(communities.communities(nodes, edges))
    label = {r["id"]: r["community"] for r in found.collect()}
    assert max(cells for cells, _ in seen) > 1 and len(seen) < 40
    assert modularity_by_hand(pairs, label) >= louvain_by_hand(pairs) - 0.03
    assert communities.single_moves(edges, found).filter("gain > 1e-12").isEmpty()


def test_betweenness_in_batches(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(9)] + [(rng.randrange(10), rng.randrange(10)) for _ in range(5)]
    edges, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.range(11).select("id")
    whole = {r["id"]: r["centrality"] for r in centrality.betweenness_centrality(nodes, edges).collect()}
    parts = {r["id"]: r["centrality"] for r in centrality.betweenness_centrality(nodes, edges, batch=4).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole) and max(whole.values()) > 0


def test_inverted_lists(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(scale=0.1, size=8)]) for i in range(240)] + [(900, [0.0] * 8), (901, None)]
    store = spark.createDataFrame(rows, "node_id long, embedding array<float>").repartition(3)
    path = str(tmp_path / "index")
    ivf.write_index(store, ivf.train(store, 6), path)
    filed = spark.read.parquet(f"{path}/vectors")
    assert filed.count() == 240
    queries = store.filter("node_id < 24").withColumnRenamed("node_id", "query_id")
    found = ivf.search_index(spark, path, queries, 5, 2)
    exact = ivf.search_index(spark, path, queries, 5, 6)
    matrix = np.array([r[1] for r in rows[:240]])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for r in exact.groupBy("query_id").agg(F.collect_list("node_id").alias("n")).collect():
        assert set(r["n"]) == set(np.argsort(-np.round(unit @ unit[r["query_id"]], 9), kind="stable")[:5].tolist())
    assert ivf.recall(found, exact).agg(F.min("recall")).first()[0] >= 0.9
    one = ivf.search_index(spark, path, queries.limit(1), 5, 1)
    assert one.count() == 5
    plan = filed.filter(F.col("list").isin([0])).select("node_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan
    assert ivf.search_index(spark, path, queries.filter("false"), 5, 2).count() == 0


@pytest.fixture(scope="module")
def library(spark):
    papers = [(f"paper_{i}", "paper", f"Battery study number {i}", 2000 + i % 5, None) for i in range(30)]
    people = [("author_1", "author", None, None, "John Smith"), ("author_2", "author", None, None, "Mary Jones")]
    nodes = spark.createDataFrame(papers + people, "id string, node_type string, title string, year int, name string")
    for name, kind in (("journal", "string"), ("abstract", "string"), ("authors", "array<string>"), ("keywords", "array<string>"), ("top_keywords", "array<string>"), ("paper_count", "bigint"), ("productivity_type", "string"), ("frequency", "bigint")):
        nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    edges = spark.createDataFrame([(f"paper_{i}", f"paper_{i + 1}", "cites") for i in range(29)] + [("author_1", f"paper_{i}", "authored_by") for i in range(5)], "src string, dst string, edge_type string")
    store = nodes.select(F.col("id").alias("node_id"), "node_type", encoding.encode(F.coalesce("title", "name")).alias("embedding"))
    return question_path.open_corpus(nodes, edges, store)


def test_questions_are_routed_and_answered(spark, library):
    asked = spark.createDataFrame([
        ("a", "Battery study number 3"), ("b", "Compare research trend and change between 2001 and 2003 for battery papers"), ("c", "Battery study number 3"),
        ("d", "???"), ("e", "Give a comprehensive overall network analysis of hidden patterns: battery study"),
    ], "query_id string, question string")
    how = {"k": 3, "min_similarity": 0.2, "max_nodes": 12}
    analysed = durable(question_path.analyse(asked, encoding.encode))
    seeds = question_path.find_seeds(analysed, library.store, 3, 0.2).collect()
    wanted = {r["query_id"]: r["required_node_types"] for r in analysed.collect()}
    assert all(("author" if r["node_id"].startswith("author") else "paper") in wanted[r["query_id"]] for r in seeds)
    found = question_path.extract(analysed, library, **how)
    summary = {r["query_id"]: r for r in found.summary.collect()}
    assert set(summary) == set("abcde") and summary["d"]["total_nodes"] == 0 and summary["a"]["total_nodes"] > 3
    strategy = {r["query_id"]: r["strategy"] for r in analysed.collect()}
    sizes = {}
    for r in found.members.collect():
        assert r["strategy"] == strategy[r["query_id"]]
        sizes[r["query_id"]] = sizes.get(r["query_id"], 0) + 1
    assert max(sizes.values()) <= 12 and len(set(strategy.values())) > 1
    answers = {r["query_id"]: r for r in question_path.ask(asked, library, encoding.encode, lambda: lambda p: "An answer of ten words that says what was asked here.", **how).collect()}
    assert set(answers) == set("abcde") and answers["a"]["source_nodes"] == answers["c"]["source_nodes"] != []
    assert answers["d"]["source_nodes"] == [] and all(r["error"] is None for r in answers.values())


def test_only_changed_nodes_are_encoded(spark, tmp_path, library):
    path, nodes = str(tmp_path / "vectors"), library.nodes
    first = embedding_store.update(nodes, path, encoding.encode)
    assert (first["encoded"], first["kept"], first["removed"]) == (32, 0, 0)
    changed = nodes.filter("id <> 'paper_9'").withColumn("title", F.when(F.col("id") == "paper_3", "Another title altogether").otherwise(F.col("title")))
    again = embedding_store.update(changed, path, encoding.encode)
    assert (again["encoded"], again["kept"], again["removed"]) == (1, 30, 1)
    embedding_store.compact(spark, path)
    third = embedding_store.update(changed, path, encoding.encode)
    assert (third["encoded"], third["kept"], third["removed"]) == (0, 31, 0)
    stored = embedding_store.read_store(spark, path)
    assert stored.count() == 31 and stored.filter("embedding is null").isEmpty()
    (tmp_path / "vectors" / "change-00000099").mkdir()  # a run that was lost has no mark and is not read
    assert embedding_store.read_store(spark, path).count() == 31
