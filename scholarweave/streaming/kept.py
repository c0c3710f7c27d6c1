"""Answer caches that outlive a run: keyed state of a stream, a log of its changes, and whole states to start again from.

Every owner (a session, a model) has a cache of at most ``capacity`` answers. A call finds its answer when that is younger than the limit;
otherwise its answer is saved, and when the cache is then too full the ``drop`` oldest go. Answers past the limit count for nothing.
A timer removes them from the state of owners that stay away.

A store is a folder of versions like that of the kept vectors (``embedding_store``): each micro-batch writes the entries that it added and
removed under its own number, so a batch that is run twice writes the same version twice. The state is the latest row of each
(owner, key). ``compact`` writes it as one version. A run that ends without it goes on from its own progress; after it, the
next run takes that version as the initial state of its stream. Calls of one owner in one micro-batch are put in order in one
task: ``maxFilesPerTrigger`` and the like bound how many that are; the state itself is bounded by ``capacity``.

Keyed state with timers and an initial state needs the RocksDB state store (part of Spark) and protobuf for Python on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scholarweave.operators.embedding_store import version_folder, versions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ENTRY = "owner string, key string, born long, value string, gone boolean, step long"
OUT = "owner string, kind string, key string, at long, hit boolean, value string, born long, gone boolean, step long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class AnswerCache(StatefulProcessor):
    """State of one owner: the answers by key, and how many changes there were, which orders the log."""

    def __init__(self, ttl_seconds: int, capacity: int, drop: int) -> None:
        self.ttl, self.capacity, self.drop = ttl_seconds * 1_000_000, capacity, drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "born long, value string")
        self.steps = handle.getValueState("steps", "step long")

    def _wake(self, born: list[int]) -> None:
        """One timer an owner: when its oldest answer is past the limit."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if born:
            self.handle.registerTimer((min(born) + self.ttl) // 1000 + 1)

    def _store(self, before: dict, now: dict) -> None:
        for (key,) in [k for k in before if k not in now]:
            self.entries.removeKey((key,))
        for key, entry in now.items():
            if before.get(key) != entry:
                self.entries.updateValue(key, entry)
        self._wake([born for born, _ in now.values()])

    def _held(self) -> dict:
        return {tuple(k): tuple(v) for k, v in self.entries.iterator()}

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        now = {(k,): (int(b), v) for k, b, v in zip(initialState["key"], initialState["born"], initialState["value"])}
        self._store(self._held(), self._held() | now)
        last = self.steps.get()[0] if self.steps.exists() else 0
        self.steps.update((max(last, int(initialState["step"].max())),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows)).sort_values(["at", "key"], kind="stable")
        before, step = self._held(), self.steps.get()[0] if self.steps.exists() else 0
        now, out = dict(before), []

        def gone(which: tuple) -> None:
            nonlocal step
            step += 1
            out.append((key[0], "change", which[0], None, None, None, now.pop(which)[0], True, step))

        for name, at, value in zip(calls["key"], calls["at"], calls["value"]):
            at = int(at)
            for old in [k for k, (born, _) in now.items() if at - born >= self.ttl]:
                gone(old)
            hit = (name,) in now
            if not hit:
                step += 1
                now[(name,)] = (at, value)
                out.append((key[0], "change", name, None, None, value, at, False, step))
                if len(now) > self.capacity:
                    for old in sorted(now, key=lambda k: (now[k][0], k[0]))[: self.drop]:
                        gone(old)
            # an answer that was put out at once is still the call's own
            out.append((key[0], "call", name, at, hit, now[(name,)][1] if (name,) in now else value, None, None, None))
        self._store(before, now)
        self.steps.update((step,))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        before, step, out = self._held(), self.steps.get()[0], []
        now = {k: e for k, e in before.items() if e[0] + self.ttl > passed}
        for which in [k for k in before if k not in now]:
            step += 1
            out.append((key[0], "change", which[0], None, None, None, before[which][0], True, step))
        self._store(before, now)
        self.steps.update((step,))
        yield pd.DataFrame(out, columns=COLUMNS)


def read_cache(spark: SparkSession, path: str, gone: bool = False) -> DataFrame:
    """owner, key, born (microseconds), value and step of the answers that the store has now; with ``gone`` the removed ones too."""
    rows = spark.createDataFrame([], ENTRY)
    for number, whole in versions(spark, path):
        rows = rows.unionByName(spark.read.schema(ENTRY).parquet(version_folder(path, number, whole)))
    latest = rows.groupBy("owner", "key").agg(F.max_by(F.struct("born", "value", "gone"), "step").alias("s"), F.max("step").alias("step"))
    kept = latest.select("owner", "key", "s.born", "s.value", "s.gone", "step")
    return kept if gone else kept.filter("not gone").drop("gone")


def compact(spark: SparkSession, path: str) -> None:
    """Writes the state as a version of its own, from which the next run starts; earlier versions are not read any more."""
    there = versions(spark, path)
    if there and not there[-1][1]:
        read_cache(spark, path, gone=True).select(*[c.split()[0] for c in ENTRY.split(", ")]).write.mode("overwrite").parquet(
            version_folder(path, there[-1][0] + 1, True)
        )


def clear(spark: SparkSession, path: str, owners: DataFrame) -> None:
    """Forgets all answers of ``owners`` (column owner), between runs: a whole version without them."""
    compact(spark, path)
    there = versions(spark, path)
    if there:
        wiped = read_cache(spark, path, gone=True).join(owners.select("owner").distinct(), "owner", "left_anti")
        wiped.select(*[c.split()[0] for c in ENTRY.split(", ")]).write.mode("overwrite").parquet(version_folder(path, there[-1][0] + 1, True))


def run_calls(calls: DataFrame, path: str, ttl_seconds: int = 3600, capacity: int = 50, drop: int = 10) -> DataFrame:
    """Runs a stream of calls over everything that is there: (owner, key, at, hit, value) of all calls the store has answered.

    ``calls``: owner, key, ts (timestamp) and value, the answer to save where none is found. Calls are answered in the order of their
    time within a micro-batch; the watermark, which lags by the limit, decides when timers fire. After ``compact`` a
    run begins with that state and new progress, and is to be given only calls that no earlier run has seen. A null owner or key
    is an empty one; calls without a time are left out.
    """
    spark = calls.sparkSession
    there = versions(spark, path)
    base = next((number for number, whole in there if whole), 0)
    rows = calls.withWatermark("ts", f"{ttl_seconds} seconds").filter("ts IS NOT NULL").select(
        F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("key", F.lit("")).alias("key"), "value", F.unix_micros("ts").alias("at"), "ts"
    )
    start = None
    if base:
        first = spark.read.schema(ENTRY).parquet(version_folder(path, base, True)).filter("not gone")
        start = first.select("owner", "key", "born", "value", "step").groupBy("owner")
    out = rows.groupBy("owner").transformWithStateInPandas(
        AnswerCache(ttl_seconds, capacity, drop), outputStructType=OUT, outputMode="Append", timeMode="EventTime", initialState=start
    )

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        answered = batch.filter("kind = 'call'").select("owner", "key", "at", "hit", "value")
        answered.write.mode("overwrite").parquet(f"{path}/calls/run={base}/batch={number}")
        changes = batch.filter("kind = 'change'").select(*[c.split()[0] for c in ENTRY.split(", ")])
        changes.write.mode("overwrite").parquet(version_folder(path, base + 1 + number, False))
        batch.unpersist()

    earlier = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        query = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress-{base:08d}").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER_KEY, earlier)
    query.awaitTermination()
    return answers(spark, path)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All calls that the store's runs have answered."""
    return spark.read.schema("owner string, key string, at long, hit boolean, value string").option("recursiveFileLookup", "true").parquet(f"{path}/calls")
