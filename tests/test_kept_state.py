"""Caches that outlive a run, against a cache in plain Python."""

import random

from pyspark.sql import functions as F

from scholarweave.operators import memory, session_store
from scholarweave.sources import writers
from scholarweave.streaming import kept

SCHEMA = "owner string, key string, second long, value string"


def by_hand(calls, ttl, capacity, drop):
    caches, out = {}, []
    for owner, key, at, value in sorted(calls, key=lambda c: (c[2], c[1])):
        cache = caches.setdefault(owner, {})
        for old in [k for k, (born, _) in cache.items() if at - born >= ttl]:
            del cache[old]
        hit = key in cache
        if not hit:
            cache[key] = (at, value)
        answer = cache[key][1]
        if not hit and len(cache) > capacity:
            for old in sorted(cache, key=lambda k: (cache[k][0], k))[:drop]:
                del cache[old]
        out.append((owner, key, at, hit, answer))
    return sorted(out), caches


def stream(spark, folder):
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return rows.select("owner", "key", F.timestamp_seconds("second").alias("ts"), "value")


def write(spark, calls, folder):
    spark.createDataFrame(calls, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_stopped_cache_goes_on_with_the_same_answers(spark, tmp_path):
    rng = random.Random(3)
    owners = ["hot"] * 5 + ["a", "b"]
    calls = [(rng.choice(owners), f"k{rng.randrange(9)}", 1_700_000_000 + 7 * i, f"v{i}") for i in range(240)]
    want, caches = by_hand(calls, 300, 5, 2)
    path, parts = str(tmp_path / "store"), [calls[:90], calls[90:150], calls[150:]]
    # the first two go through one progress folder, the third starts from the whole state
    write(spark, parts[0], str(tmp_path / "one"))
    kept.run_calls(stream(spark, str(tmp_path / "one")), path, 300, 5, 2)
    write(spark, parts[1], str(tmp_path / "one"))
    kept.run_calls(stream(spark, str(tmp_path / "one")), path, 300, 5, 2)
    kept.compact(spark, path)
    assert [whole for _, whole in kept.versions(spark, path)] == [True]
    write(spark, parts[2], str(tmp_path / "two"))
    out = kept.run_calls(stream(spark, str(tmp_path / "two")), path, 300, 5, 2)
    got = sorted((r["owner"], r["key"], r["at"] // 1_000_000, r["hit"], r["value"]) for r in out.collect())
    assert got == want and any(h for *_, h, _ in want)
    last = calls[-1][2]
    alive = {(o, k) for o, c in caches.items() for k, (born, _) in c.items() if last - born < 300}
    held = {(r["owner"], r["key"]) for r in kept.read_cache(spark, path).filter(F.col("born") > (last - 300) * 1_000_000).collect()}
    assert held == alive
    kept.clear(spark, path, spark.createDataFrame([("hot",)], "owner string"))
    assert {r["owner"] for r in kept.read_cache(spark, path).collect()} <= {"a", "b"}


def turns(spark, rows):
    return spark.createDataFrame(rows, "session_id string, turn long, human string")


def test_histories_survive_and_clear(spark, tmp_path):
    path = str(tmp_path / "histories")
    assert session_store.read_histories(spark, path).count() == 0
    session_store.append_turns(turns(spark, [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c"), (None, 1, "x"), ("t", None, "y")]), path)
    session_store.append_turns(turns(spark, [("s", 2, "b2"), ("s", 3, None)]), path)
    held = lambda: sorted((r["session_id"], r["turn"], r["human"]) for r in session_store.read_histories(spark, path).collect())
    assert held() == [("s", 1, "a"), ("s", 2, "b2"), ("s", 3, None), ("t", 1, "c")]
    session_store.clear_sessions(spark.createDataFrame([("s",), (None,)], "session_id string"), path)
    session_store.append_turns(turns(spark, [("s", 1, "new")]), path)
    assert held() == [("s", 1, "new"), ("t", 1, "c")]
    session_store.compact(spark, path)
    assert held() == [("s", 1, "new"), ("t", 1, "c")]
    one = session_store.read_histories(spark, path, spark.createDataFrame([("t",), ("nobody",)], "session_id string"))
    assert [r["session_id"] for r in one.collect()] == ["t"]


def test_kinds_of_memory(spark):
    kinds = spark.createDataFrame([("buffer", "BUFFER"), ("window", "window"), ("odd", None)], "session_id string, memory_type string")
    rows = turns(spark, [(s, i, "") for s in ("buffer", "window", "odd", "none") for i in range(12)])
    shown = {r["session_id"]: r["n"] for r in memory.select_memory(rows, kinds).groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert shown == {"buffer": 12, "window": 10, "odd": 5, "none": 5}


def test_a_cached_result_is_made_anew_when_its_source_changes(spark, tmp_path):
    import os

    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    source, folder = tmp_path / "graph.json", str(tmp_path / "cache")
    source.write_text("{}")
    os.utime(source, (1_700_000_000, 1_700_000_000))
    ask = lambda settings: writers.cached(spark, folder, settings, str(source), make).count()
    assert (ask({"a": 1}), ask({"a": 1}), len(made)) == (1, 1, 1)
    os.utime(source, (1_700_000_000.5, 1_700_000_000.5))
    assert (ask({"a": 1}), len(made)) == (1, 1)
    assert (ask({"a": 2}), len(made)) == (2, 2)
    os.utime(source, (1_700_000_090, 1_700_000_090))
    assert (ask({"a": 1}), len(made)) == (3, 3)
