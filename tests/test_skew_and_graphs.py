"""Skew-safe operators and graph algorithms against brute force on small fixtures."""

import itertools
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarweave.operators import centrality, communities, components, expansion, graph_stats, unify, vectors
from scholarweave.operators.pairs import pairs_in_group
from scholarweave.operators.ranking import exact_quantiles, group_rank

NODES = ["a", "b", "c", "d", "e", "f", "g"]
EDGES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("a", "b"), ("f", "f")]


def graph(spark, nodes=NODES, edges=EDGES):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")


def adjacency(edges):
    around = defaultdict(set)
    for a, b in edges:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    return around


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_a_large_group_are_complete(spark, block):
    rows = [("hot", i) for i in range(40)] + [("cold", i) for i in range(3)]
    out = pairs_in_group(spark.createDataFrame(rows, "g string, i int"), "g", "i", block).collect()
    want = [("hot", a, b) for a, b in itertools.combinations(range(40), 2)] + [("cold", a, b) for a, b in itertools.combinations(range(3), 2)]
    assert sorted(map(tuple, out)) == sorted(want)


def test_group_rank_spreads_one_key_and_counts_right(spark):
    rows = [("hot", i * 7 % 1000) for i in range(1000)] + [("cold", 5), ("cold", 3)]
    out = group_rank(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], "r", "n").collect()
    assert all(r["r"] == r["v"] + 1 and r["n"] == 1000 for r in out if r["k"] == "hot")
    assert sorted((r["v"], r["r"], r["n"]) for r in out if r["k"] == "cold") == [(3, 1, 2), (5, 2, 2)]


def test_quantiles_equal_numpy(spark):
    values = [1.0] * 50 + [random.Random(1).random() * 10 for _ in range(77)]
    out = {r[0]: r[1] for r in exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p, q in out.items():
        assert abs(q - np.quantile(values, p)) < 1e-9


def test_components(spark):
    nodes, edges = graph(spark)
    out = dict(map(tuple, components.connected_components(nodes, edges).collect()))
    assert out == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "g"}
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    nodes, edges = graph(spark, [f"n{i:03d}" for i in range(121)], chain)
    assert {r["component"] for r in components.connected_components(nodes, edges).collect()} == {"n000"}


def test_strong_components(spark):
    nodes, edges = graph(spark)
    out = dict(map(tuple, components.strongly_connected_components(nodes, edges).collect()))
    assert out == {"a": "a", "b": "b", "c": "c", "d": "e", "e": "e", "f": "f", "g": "g"}


def strong_by_reach(nodes, edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for v in nodes:
        seen, stack = {v}, [v]
        while stack:
            for w in out[stack.pop()] - seen:
                seen.add(w)
                stack.append(w)
        reach[v] = seen
    return {v: max(w for w in reach[v] if v in reach[w]) for v in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_of_a_mixed_graph(spark, seed):
    """Random edges, a path of 60 nodes, and a ring with a chord."""
    rng = random.Random(seed)
    names = [f"v{i:03d}" for i in range(50)]
    pairs = [(a, b) for a in names for b in names if rng.random() < 0.025]
    path, ring = [f"p{i:02d}" for i in range(60)], [f"r{i:02d}" for i in range(30)]
    pairs += list(zip(path, path[1:])) + list(zip(ring, ring[1:] + ring[:1])) + [("r20", "r05"), ("v007", "p10"), ("p50", "r03")]
    everyone = names + path + ring + ["alone"]
    got = dict(map(tuple, components.strongly_connected_components(*graph(spark, everyone, pairs)).collect()))
    assert got == strong_by_reach(everyone, pairs)


def test_a_ring_of_ten_thousand_nodes_takes_few_rounds(spark):
    ring = spark.range(10000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 10000).alias("dst"))
    found = components.strongly_connected_components(spark.range(10000), ring, max_rounds=39)
    assert [tuple(r) for r in found.select("component").distinct().collect()] == [(9999,)]


def brandes(nodes, around):
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, paths, dist, queue = [], defaultdict(list), defaultdict(float), {s: 0}, deque([s])
        paths[s] = 1.0
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in around[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        dep = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_equals_brandes(spark):
    rng = random.Random(4)
    names = [f"v{i:02d}" for i in range(15)]
    pairs = [p for p in itertools.combinations(names, 2) if rng.random() < 0.18]
    nodes, edges = graph(spark, names, pairs)
    want, got = brandes(names, adjacency(pairs)), dict(map(tuple, centrality.betweenness_centrality(nodes, edges).collect()))
    assert all(abs(want[v] - got[v]) < 1e-9 for v in names)


def test_clustering(spark):
    nodes, edges = graph(spark)
    out = {r["id"]: r["clustering"] for r in graph_stats.clustering(nodes, edges).collect()}
    assert out["a"] == out["b"] == 1.0 and abs(out["c"] - 1 / 3) < 1e-9 and out["g"] == 0.0


def test_communities_find_two_cliques(spark):
    left, right = [f"l{i}" for i in range(5)], [f"r{i}" for i in range(5)]
    pairs = [*itertools.combinations(left, 2), *itertools.combinations(right, 2), ("l0", "r0")]
    nodes, edges = graph(spark, left + right, pairs)
    out = dict(map(tuple, communities.communities(nodes, edges, levels=2, rounds=6).collect()))
    assert len({out[v] for v in left}) == 1 and len({out[v] for v in right}) == 1 and out["l0"] != out["r0"]


def vectors_of(n=60, d=8, copies=20, seed=3):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d)).astype("float32")
    rows[:copies] = rows[0]  # a third of all rows is one vector
    return rows


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_neighbours_both_ways_equal_brute_force(spark, limit):
    rows = vectors_of()
    store = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "node_id long, embedding array<float>")
    out = vectors.neighbours(store, 4, positive_only=False, limit_bytes=limit, cell=16).collect()
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    for i in range(len(rows)):
        want = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-scores[i, j], j))[:4]
        got = [r["dst"] for r in sorted((r for r in out if r["src"] == i), key=lambda r: r["rank"])]
        assert got == want


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_search_both_ways_and_zero_query(spark, limit):
    rows = vectors_of()
    store = spark.createDataFrame([(f"n{i:02d}", "x" if i % 2 else "y", [float(x) for x in v]) for i, v in enumerate(rows)], "node_id string, node_type string, embedding array<float>")
    asked = spark.createDataFrame([("q1", [float(x) for x in rows[30]]), ("zero", [0.0] * 8)], "query_id string, embedding array<float>")
    out = vectors.search(store, asked, 3, node_types=["y"], limit_bytes=limit).collect()
    assert {r["query_id"] for r in out} == {"q1"} and len(out) == 3 and min(out, key=lambda r: r["rank"])["node_id"] == "n30"


def greedy(order, seeds, around, score, limit):
    inside = set(seeds)
    for v in order:
        if len(inside) >= limit:
            break
        if v not in inside and (around[v] & inside or score[v] > 0.1):
            inside.add(v)
    return inside


@pytest.mark.parametrize("limit", [6, 12, 100])
def test_global_expansion_equals_the_sequential_pass(spark, limit):
    rng = random.Random(9)
    names = [f"v{i:02d}" for i in range(40)]
    pairs = [p for p in itertools.combinations(names, 2) if rng.random() < 0.05]
    around = adjacency(pairs)
    score = {v: len(around[v]) / 39 for v in names}
    order = sorted(names, key=lambda v: (-score[v], v))
    seeds = spark.createDataFrame([("q", "v03", 0.9), ("q", "v17", 0.8)], "query_id string, node_id string, similarity double")
    _, edges = graph(spark, names, pairs)
    central = spark.createDataFrame(list(score.items()), "node_id string, centrality double")
    got = expansion.expand_global(seeds, expansion.neighbours(edges), central, limit).collect()
    assert {r["node_id"] for r in got} == greedy(order, ["v03", "v17"], around, score, limit)


def test_merge_takes_longest_text_and_first_writer(spark):
    schema = "id string, node_type string, title string, abstract string, year int"
    one = spark.createDataFrame([("p", "paper", "T", "short", 2001)], schema)
    two = spark.createDataFrame([("p", "paper", "T2", "machine learning for a battery", 2002)], schema)
    merged = unify.merge_nodes(unify.unite([unify.standardize_nodes(two, "semantic"), unify.standardize_nodes(one, "citation")])).first()
    assert merged["title"] == "T2" and merged["year"] == 2001 and merged["is_interdisciplinary"] and merged["source_graphs"] == ["citation", "semantic"]


def test_partition_count_does_not_change_results(spark):
    nodes, edges = graph(spark)
    runs = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, graph_stats.degrees(nodes, edges).select("id", "degree").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1]


def test_subgraph_edges_stay_inside(spark):
    nodes, edges = graph(spark)
    seeds = spark.createDataFrame([("q", "a", 0.9)], "query_id string, node_id string, similarity double")
    grown = expansion.expand_local(seeds, expansion.neighbours(edges), 4, 3)
    inside = {r["node_id"] for r in grown.collect()}
    kept = expansion.induced_edges(grown, edges.withColumn("edge_type", F.lit("cites"))).collect()
    assert len(inside) == 4 and all(r["src"] in inside and r["dst"] in inside for r in kept)


def test_neighbours_store_no_copies_of_vectors(spark):
    """Random vectors, whose cells cannot rule each other out: nothing is stored, and lists of text ids with copies and a repeated id are right."""
    from pathlib import Path

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 16)).astype("float32")
    rows[100:110] = rows[100]
    rows[7] = 0.0
    names = [f"n{i:03d}" for i in range(599)] + ["n000"]
    store = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, rows)], "node_id string, embedding array<float>")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    stored = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = stored()
    out = defaultdict(list)
    for r in vectors.neighbours(store, 30, positive_only=False, limit_bytes=0, cell=40).collect():
        out[r["src"]].append((r["rank"], r["dst"]))
    assert stored() == before
    unit = rows.astype(float) / np.maximum(np.linalg.norm(rows.astype(float), axis=1, keepdims=True), 1e-30)
    scores = np.round(unit @ unit.T, 9)
    for i in range(1, 599):
        want = sorted((j for j in range(600) if names[j] != names[i]), key=lambda j: (-scores[i, j], names[j]))[:30]
        assert [d for _, d in sorted(out[names[i]])] == [names[j] for j in want]
    assert len(out["n000"]) == 60 and all(d != "n000" for _, d in out["n000"])


@pytest.mark.parametrize("held", [40, 1 << 23])
def test_triangles_in_cells_equal_brute_force(spark, held, monkeypatch):
    """Held in many blocks and in one, with few paths at a time: a dense part, a hub, loops, repeated and unknown ids."""
    from scholarweave.operators import triangles

    rng = random.Random(8)
    names = [f"v{i:02d}" for i in range(40)]
    pairs = [p for p in itertools.combinations(names[:25], 2) if rng.random() < 0.6] + [("v30", v) for v in names if v != "v30"] + [("v03", "v03"), ("v01", "v00"), ("v00", "v01")]
    nodes, edges = graph(spark, names, pairs + pairs[:20])
    monkeypatch.setattr(triangles.count_triangles, "__defaults__", (held,))
    around = adjacency(pairs)
    out = {r["id"]: r for r in graph_stats.clustering(nodes, edges).collect()}
    assert len(out) == 40
    for v in names:
        closed = sum(1 for a, b in itertools.combinations(sorted(around[v]), 2) if b in around[a])
        n = len(around[v])
        assert (out[v]["degree"], out[v]["triangles"]) == (n, closed) and abs(out[v]["clustering"] - (2 * closed / (n * (n - 1)) if n > 1 else 0)) < 1e-12


def test_cells_split_marks_and_paths(monkeypatch):
    from scholarweave.operators import triangles

    monkeypatch.setattr(triangles, "PATHS", 3)
    monkeypatch.setattr(triangles, "MARKS", 20)
    rng = np.random.default_rng(2)
    after = {u: np.sort(rng.choice(np.arange(u + 1, 60), size=min(59 - u, 7), replace=False)).astype(np.int32) for u in range(59)}
    lists = np.array(list(after), np.int32), np.array([len(v) for v in after.values()]), np.concatenate(list(after.values()))
    cell = triangles._Cell([lists])
    got = defaultdict(int)
    for batch in (cell.meet(*lists), cell.counts()):
        for r in batch.to_pylist():
            got[r["r"]] += r["n"]
    want = defaultdict(int)
    for u, vs in after.items():
        for v in vs:
            for w in set(vs.tolist()) & set(after.get(int(v), np.array([])).tolist()):
                for corner in (u, int(v), w):
                    want[corner] += 1
    assert want and got == want


def test_a_scan_of_many_queries_holds_few_scores():
    """3,000 queries against one batch of 10,000 rows: scores of all pairs would be 240 MB."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    asked, rows = rng.normal(size=(3000, 8)), rng.normal(size=(10000, 8)).astype("float32")
    rows[50:5000] = rows[50]
    arrow = pa.schema([("query_id", pa.int64()), ("node_id", pa.int64()), ("similarity", pa.float64())])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10000)), pa.array(list(rows), pa.list_(pa.float32()))], ["node_id", "embedding"])
    run = vectors._scan(np.arange(3000), asked, 5, "cosine", arrow)
    tracemalloc.start()
    found = [b for b in run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    got = defaultdict(list)
    for b in found:
        for q, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[q].append(n)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked[:40]) @ unit(rows.astype(float)).T, 9)
    for q in range(40):
        assert sorted(got[q]) == sorted(np.lexsort((np.arange(10000), -scores[q]))[:5].tolist())


def path_counts(n, edges):
    names = [f"v{i:03d}" for i in range(n)]
    around = adjacency([(names[a], names[b]) for a, b in edges])
    return names, around, brandes(names, around)


def test_betweenness_in_cells_and_by_joins_equals_brandes(spark, monkeypatch):
    """A chain in several cells, a denser component beyond the bound, a pair and a lone node."""
    from scholarweave.operators import path_cells

    monkeypatch.setattr(path_cells, "WORK", 20)
    rng = random.Random(11)
    pairs = [(i, i + 1) for i in range(5)] + [(10, i) for i in range(11, 18)] + [(i, j) for i in range(11, 18) for j in range(11, i) if rng.random() < 0.4] + [(20, 21)]
    names, _, want = path_counts(23, pairs)
    nodes, edges = graph(spark, names, [(names[a], names[b]) for a, b in pairs])
    got = dict(map(tuple, centrality.betweenness_centrality(nodes, edges, held=12).collect()))
    assert got.keys() == want.keys() and all(abs(want[v] - got[v]) < 1e-9 for v in names)


def test_a_cell_follows_few_entries_at_once(monkeypatch):
    from scholarweave.operators import path_cells

    rng = random.Random(12)
    pairs = [(0, i) for i in range(1, 40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    _, around, want = path_counts(40, pairs)
    lists = [sorted(int(x[1:]) for x in around[f"v{i:03d}"]) for i in range(40)]
    paths = path_cells.Paths(np.array([len(x) for x in lists]), np.array([v for x in lists for v in x], dtype=np.int32))
    for step, states in ((7, 40), (1 << 20, 400)):
        monkeypatch.setattr(path_cells, "STEP", step)
        monkeypatch.setattr(path_cells, "STATES", states)
        got = paths.dependencies(np.arange(40)) / (39 * 38)
        assert all(abs(got[i] - want[f"v{i:03d}"]) < 1e-9 for i in range(40))


def test_betweenness_writes_no_row_for_a_source_and_a_node(spark, monkeypatch):
    written, keep = [], centrality.durable

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(centrality, "durable", counted)
    rng = random.Random(13)
    pairs = {tuple(sorted((rng.randrange(80), rng.randrange(80)))) for _ in range(160)}
    nodes, edges = graph(spark, [f"v{i}" for i in range(80)], [(f"v{a}", f"v{b}") for a, b in pairs])
    centrality.betweenness_centrality(nodes, edges).collect()
    assert max(written) <= 2 * len(pairs)
