"""Graph queries on small tables of their own: the whole job, and the same rows as a plain computation."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scholarweave.operators import components, expansion, path_cells, vectors
from scholarweave.plans import graph


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def angle(*degrees):
    return [[float(np.cos(np.radians(x))), float(np.sin(np.radians(x)))] for x in degrees]


def test_components_follow_every_similar_pair(spark, tmp_path):
    """0 and 1, 2 and 3 are each other's nearest; 1 and 2 are similar as well, 4 is not."""
    rows = [(i, v, 0) for i, v in enumerate(angle(0, 10, 60, 70, 200))] + [(5, [0.0, 0.0], 0), (6, None, 0)]
    d = written(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, entry.queries()["connected_components"](spark, d).collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5), (6, 6)]
    assert sorted(map(tuple, entry.queries()["component_sizes"](spark, d).collect())) == [(0, 4), (4, 1), (5, 1), (6, 1)]


def test_links_join_what_all_pairs_join_in_few_rows(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(300, 6)).astype("float32")
    rows[:60] = rows[0]
    names = [f"n{i:03d}" for i in range(300)]
    store = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, rows)], "node_id string, embedding array<float>")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    for least in (0.8, 0.93):
        near = np.round(unit @ unit.T, 9) >= least
        label = np.arange(300)
        while True:
            lower = np.array([label[near[i]].min() for i in range(300)])
            if (lower == label).all():
                break
            label = lower
        links = vectors.linked(store, least, cell=70)
        found = dict(map(tuple, components.connected_components(store.selectExpr("node_id AS id"), links).collect()))
        assert found == {n: names[label[i]] for i, n in enumerate(names)}
        assert links.count() <= 2 * 300 * 5


def test_eigenvector_is_settled(spark, tmp_path):
    rng = random.Random(2)
    orders = [rng.sample(range(1, 13), 2) for _ in range(14)] + [[1, 2, 3], [12, 1]]
    lines = [(o, 1, s, i) for o, some in enumerate(orders) for i, s in enumerate(some)]
    d = written(
        spark, tmp_path, supplier=([(i, f"s{i}", 0) for i in range(1, 14)], "s_suppkey long, s_name string, s_nationkey int"),
        lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        orders=([(o, 1, datetime(2000, 1, 1)) for o in range(len(orders))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
    )
    a = np.zeros((13, 13))
    for some in orders:
        for x in some:
            for y in some:
                a[x - 1, y - 1] = x != y
    values, columns = np.linalg.eigh(a)
    want = np.abs(columns[:, -1])
    got = dict(map(tuple, entry.queries()["eigenvector_centrality"](spark, d).collect()))
    assert len(got) == 13 and all(abs(got[i + 1] - want[i]) < 2e-6 for i in range(13))


def test_growing_lists_no_more_of_a_hub_than_a_question_can_take(spark):
    """A hub of 2,000 neighbours: the same nodes as a plain search, from short lists, with pairs and with lists made before."""
    hub, rng = "a_hub", random.Random(3)
    names = [f"v{i:04d}" for i in range(2000)]
    pairs = [(hub, n) for n in names] + [(rng.choice(names), rng.choice(names)) for _ in range(1500)]
    around = {n: set() for n in [hub, *names]}
    for a, b in pairs:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    starts = {"q1": ["v0007", "v1999"], "q2": [hub], "q3": ["v0500", "v0501", "v0502"]}
    seeds = spark.createDataFrame([(q, n, 0.5) for q, some in starts.items() for n in some], "query_id string, node_id string, similarity double")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    both = expansion.neighbours(edges)
    lists = expansion.listed(both, "node_id", "neighbour", 9)
    assert max(len(r["ids"]) for r in lists.collect()) == 9
    want = set()
    for q, some in starts.items():
        inside, last = dict.fromkeys(some, 0), set(some)
        for hop in (1, 2, 3):
            last = set(sorted(set().union(*(around[n] for n in last)) - set(inside))[: max(0, 9 - len(inside))]) if last else set()
            inside |= dict.fromkeys(last, hop)
        want |= {(q, n, hop) for n, hop in inside.items()}
    score = {n: len(x) / 2000 for n, x in around.items()}
    central = spark.createDataFrame([(n, x) for n, x in score.items()], "node_id string, centrality double")
    passed = set()
    for q, some in starts.items():
        inside = set(some)
        for n in sorted(around, key=lambda n: (-score[n], n)):
            if len(inside) < 9 and n not in inside and (score[n] > 0.1 or around[n] & inside):
                inside.add(n)
        passed |= {(q, n) for n in inside}
    for given, ranked in ((both, None), (lists, expansion.ranked_neighbours(both, central, 9))):
        assert set(map(tuple, expansion.expand_local(seeds, given, 9).select("query_id", "node_id", "hop").collect())) == want
        assert set(map(tuple, expansion.expand_global(seeds, given, central, 9, ranked=ranked).select("query_id", "node_id").collect())) == passed


def test_years_and_communities_list_no_more_than_a_question_can_take(spark):
    """All nodes of a year and of a community: what is listed for a question is bounded, and the first by id are taken."""
    names = [f"p{i:04d}" for i in range(600)]
    seeds = spark.createDataFrame([("q", "p0300", 0.5), ("r", "p0000", 0.5), ("r", "p0001", 0.5)], "query_id string, node_id string, similarity double")
    nodes = spark.createDataFrame([(n, 2000 + i // 300) for i, n in enumerate(names)], "id string, year int")
    labels = spark.createDataFrame([(n, "odd" if i % 2 else "even") for i, n in enumerate(names)], "id string, community string")
    took = lambda df, q: sorted(r["node_id"] for r in df.collect() if r["query_id"] == q)
    near = expansion.expand_temporal(seeds, nodes, 5)
    assert took(near, "q") == ["p0000", "p0001", "p0002", "p0003", "p0300"] and took(near, "r") == names[:5]
    same = expansion.expand_community(seeds, labels, 5)
    assert took(same, "q") == ["p0000", "p0002", "p0004", "p0006", "p0300"] and took(same, "r") == names[:5]
    assert expansion.listed(labels, "community", "id", 5).selectExpr("max(size(ids))").first()[0] == 5


def test_seeds_need_no_topics_of_authors(spark, tmp_path, monkeypatch):
    """The nodes that questions are compared with have the same rows as the described graph, a paper of two texts included, without what others show."""
    day = datetime(2000, 1, 1)
    d = written(
        spark, tmp_path, nation=([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        customer=([(1, "c", 0, 0.0, "AUTO"), (2, "c", 1, 0.0, "HOUSE")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        supplier=([(1, "s one", 0), (2, "s two", 0), (3, None, 0)], "s_suppkey long, s_name string, s_nationkey int"),
        part=([(1, "red"), (2, "blue"), (3, "grey")], "p_partkey long, p_name string"),
        orders=([(i, 1 + i % 2, "O", 1.0, day, "1-URGENT") for i in range(5)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        lineitem=([(0, 1, 1, 1), (0, 2, 2, 2), (1, 1, 2, 1), (4, 2, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        documents=([(1, "a text"), (1, "another"), (3, None), (90, "x")], "doc_id long, text string"),
    )
    rows = lambda df: sorted(map(str, df.select("id", "node_type", "title", "name").collect()))
    assert rows(graph.named(spark, d)) == rows(graph.described(spark, d)[0])
    chats = ([(c, 0, "user", x) for c, x in enumerate(["study auto urgent 3", "red", "s two", "N1"])], "conv_id long, turn long, role string, text string")
    written(spark, tmp_path, conversations=chats)
    monkeypatch.setattr(graph, "described", lambda *a: 1 / 0)
    assert entry.queries()["question_seeds"](spark, d).count() > 0


def test_a_dense_component_is_followed_by_matrices(monkeypatch):
    """A clique, a random part and a tail: the same sums as entry by entry, without going through the entries."""
    rng = random.Random(5)
    pairs = {(i, j) for i in range(30) for j in range(i)} | {(i, j) for i in range(30, 60) for j in range(i) if rng.random() < 0.15} | {(i, i - 1) for i in range(30, 70)}
    around = [sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) for v in range(70)]
    degree, ends = np.array([len(x) for x in around]), np.array([v for x in around for v in x], np.int32)
    monkeypatch.setattr(path_cells, "SQUARE", 0, raising=False)
    want = path_cells.Paths(degree, ends).dependencies(np.arange(70))
    monkeypatch.undo()
    monkeypatch.setattr(path_cells, "STATES", 200)
    monkeypatch.setattr(path_cells.Paths, "_entries", lambda *a: 1 / 0)
    assert want.max() > 100 and np.allclose(path_cells.Paths(degree, ends).dependencies(np.arange(70)), want, rtol=1e-12)


def test_repeated_papers_count_as_before_and_hybrid_looks_up_lists(spark):
    """A node that stands several times in a year or a community takes as many places; the three steps of hybrid growth give the same with pairs and with lists."""
    seeds = spark.createDataFrame([("q", "p2", 0.5)], "query_id string, node_id string, similarity double")
    some = ["p0", "p1", "p1", "p2", "p2", "p2", "p2", "p2", "p2", "p3", "p4"]
    nodes = spark.createDataFrame([(n, 2000) for n in some], "id string, year int")
    labels = spark.createDataFrame([(n, "c") for n in some], "id string, community string")
    rows = lambda df: sorted(r["node_id"] for r in df.collect())
    assert rows(expansion.expand_temporal(seeds, nodes, 5)) == rows(expansion.expand_community(seeds, labels, 5)) == ["p0", "p1", "p1", "p2", "p3"]
    pairs = expansion.neighbours(spark.createDataFrame([(f"p{i}", f"p{i // 2}") for i in range(1, 40)], "src string, dst string"))
    central = pairs.groupBy("node_id").agg((F.count("*") / 39).alias("centrality"))
    store = spark.createDataFrame([(f"p{i}", [1.0, i / 10]) for i in range(40)], "node_id string, embedding array<float>")
    plain = expansion.expand_hybrid(seeds, pairs, store, central, 12)
    looked = expansion.expand_hybrid(seeds, expansion.listed(pairs, "node_id", "neighbour", 12), store, central, 12, ranked=expansion.ranked_neighbours(pairs, central, 12))
    assert len(rows(plain)) > 6 and rows(plain) == rows(looked)
