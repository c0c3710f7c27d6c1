"""Graph files in byte ranges against the json module."""

import json
import random

import numpy as np
import pytest

from scholarweave.sources import files, json_ranges, writers

ODD = ['a "quoted" one', "brace } and { and ] [", "back\\slash\\", "\\\\\"", "line\nbreak", "학교", '", "edges": [{"id": "no"}]', ""]


def odd_graph(seed, n=120):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))
    nodes = [{"id": f"n{i}", "title": text(), "tags": [text() for _ in range(rng.randrange(3))], "more": {"deep": [{"x": text()}]}} for i in range(n)]
    nodes.append({"id": "long", "title": "\\" * 501 + '"' * 300 + "}" * 300, "tags": [], "more": None})
    edges = [{"source": f"n{rng.randrange(n)}", "target": f"n{rng.randrange(n)}", "note": text()} for _ in range(n)]
    return {"directed": True, "graph": {"name": [1, {"nodes": [{"id": "inner"}]}]}, "nodes": nodes, "edges": edges}


@pytest.mark.parametrize(("seed", "indent", "size"), [(1, None, 997), (2, 2, 61), (3, None, 1 << 20)])
def test_ranges_find_all_objects(spark, tmp_path, seed, indent, size):
    data, path = odd_graph(seed, 120 if size > 100 else 12), tmp_path / "my graph.json"
    path.write_text(json.dumps(data, indent=indent, ensure_ascii=seed == 1), encoding="utf-8")
    if size < 100:  # few tasks for many small ranges: without Spark
        with json_ranges._open(str(path)) as source:
            got = in_small_ranges(source, path.stat().st_size, size)
        assert got == [("nodes", n) for n in data["nodes"]] + [("edges", e) for e in data["edges"]]
        return
    nodes, edges = files.read_graph_json(spark, str(path), range_bytes=size * 8)
    got = {r["id"]: r.asDict(recursive=True) for r in nodes.collect()}
    assert len(got) == nodes.count() == len(data["nodes"]) and {n["id"]: n for n in data["nodes"]} == got
    assert sorted(map(tuple, edges.select("src", "dst", "note").collect())) == sorted((e["source"], e["target"], e["note"]) for e in data["edges"])


def in_small_ranges(source, length, size):
    class Row:
        def __init__(self, at, inside, depth):
            self.at, self.size, self.in_string, self.depth = at, min(size, length - at), inside, depth

    inside, depth, rows = False, 0, []
    for at in range(0, length, size):
        rows.append(Row(at, inside, depth))
        ((_, odd, out, within),) = json_ranges._summary(source, rows[-1])
        depth, inside = depth + (within if inside else out), inside != odd
    assert not inside and depth == 0
    arrays = [a for row in rows for a in json_ranges._arrays(source, row)]
    assert [name for _, name in arrays] == ["nodes", "edges"]
    return [(key, json.loads(text)) for row in rows for key, text in json_ranges._objects(source, row, arrays)]


def test_every_border(tmp_path):
    data, path = odd_graph(5, 3), tmp_path / "g.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    want = [("nodes", n) for n in data["nodes"]] + [("edges", e) for e in data["edges"]]
    with json_ranges._open(str(path)) as source:
        for size in [1, 2, 3, 5, 7, *np.random.default_rng(1).integers(8, 900, 20).tolist()]:
            assert in_small_ranges(source, path.stat().st_size, size) == want, size


def test_empty_missing_and_broken_files(spark, tmp_path):
    for name, text in (("empty", '{"nodes": [], "edges": []}'), ("lacking", '{"nodes": [{"id": 1}]}'), ("broken", '{"nodes": [{"id": 1}'), ("none", "")):
        (tmp_path / name).write_text(text)
    nodes, edges = files.read_graph_json(spark, str(tmp_path / "empty"))
    assert nodes.count() == edges.count() == 0 and edges.columns == ["src", "dst"]
    for name in ("lacking", "broken", "none"):
        with pytest.raises(ValueError):
            files.read_graph_json(spark, str(tmp_path / name))


def test_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x\n\"y\"", ["k"]), ("b", None, [])], "id string, title string, tags array<string>")
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    writers.write_graph_json(nodes, edges, str(tmp_path / "g"))
    back, links = files.read_graph_json(spark, str(tmp_path / "g"))
    assert sorted(map(str, back.select("id", "title", "tags").collect())) == sorted(map(str, nodes.collect()))
    assert [tuple(r) for r in links.select("src", "dst", "weight").collect()] == [("a", "b", 0.5)]
