"""Conversation memory per session, and answer caches with a time to live.

``turns``: session_id, turn (orders the session), ts, tokens, relevance and keywords. A
session may be as long as it likes: positions come from ``group_rank``, which spreads
one long session over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.operators.ranking import group_rank, top_per_group
from scholarweave.session import durable

KEEP_SHARE, KEEP_LEAST = 0.3, 3


def turn_tokens(human: Column, ai: Column) -> Column:
    return (F.length(F.concat(human, ai)) / 4).cast("long")


def needs_compression(turns: DataFrame, max_tokens: int = 4000, max_turns: int = 20) -> DataFrame:
    """(session_id, turns, tokens, compress)."""
    sized = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    return sized.withColumn("compress", (F.col("tokens") > max_tokens) | (F.col("turns") > max_turns))


def _target() -> Column:
    return F.greatest(F.lit(KEEP_LEAST), F.floor(F.col("_size") * KEEP_SHARE))


def keep_recent(turns: DataFrame) -> DataFrame:
    """The last third or so of each session (also stands in for the semantic strategy)."""
    ranked = group_rank(turns, ["session_id"], ["turn"], "_r", "_size", descending=["turn"])
    return ranked.filter(F.col("_r") <= _target()).drop("_r", "_size")


def keep_relevant(turns: DataFrame, now: Column) -> DataFrame:
    """Highest relevance plus a bonus that fades over 24 hours; the earlier turn wins a tie."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / F.lit(3.6e9)
    scored = turns.withColumn("_score", F.round(F.col("relevance") + F.greatest(F.lit(0.0), 1.0 - age / 24) * 0.3, 9))
    ranked = group_rank(scored, ["session_id"], ["_score", "turn"], "_r", "_size", descending=["_score"])
    return ranked.filter(F.col("_r") <= _target()).drop("_r", "_size", "_score")


def keep_frequent(turns: DataFrame) -> DataFrame:
    """Turns whose keywords are most frequent in their session."""
    words = turns.select("session_id", "turn", F.explode("keywords").alias("w")).withColumn("w", F.lower("w"))
    counts = words.groupBy("session_id", "w").agg(F.count("*").alias("_n"))
    sums = words.join(counts, ["session_id", "w"]).groupBy("session_id", "turn").agg(F.sum("_n").alias("_score"))
    scored = turns.join(sums, ["session_id", "turn"], "left").na.fill(0, ["_score"])
    ranked = group_rank(scored, ["session_id"], ["_score", "turn"], "_r", "_size", descending=["_score"])
    return ranked.filter(F.col("_r") <= _target()).drop("_r", "_size", "_score")


def keep_hybrid(turns: DataFrame, threshold: float = 0.3, buffer: int = 10) -> DataFrame:
    """Relevant turns (all, if none is). Beyond ``buffer``: the recent half, filled up with the
    most relevant older ones.
    """
    best = turns.groupBy("session_id").agg(F.max("relevance").alias("_best"))
    pool = turns.join(best, "session_id").filter((F.col("relevance") >= threshold) | (F.col("_best") < threshold)).drop("_best")
    placed = durable(group_rank(pool, ["session_id"], ["turn"], "_r", "_size"))
    half = F.floor(F.col("_size") / 2)
    recent = placed.filter((F.col("_size") <= buffer) | (F.col("_r") > F.col("_size") - half))
    older = placed.filter((F.col("_size") > buffer) & (F.col("_r") <= F.col("_size") - half))
    best_older = top_per_group(older, ["session_id"], [F.desc("relevance"), F.asc("turn")], buffer, "_o").filter(F.col("_o") <= buffer - half)
    return recent.unionByName(best_older.drop("_o")).drop("_r", "_size")


def last_turns(turns: DataFrame, k: int = 10) -> DataFrame:
    """Window memory: the last k turns of each session."""
    return top_per_group(turns, ["session_id"], [F.desc("turn")], k, "_r").drop("_r")


WHOLE, WINDOWED = ("buffer",), ("window", "summary_buffer", "graphrag_enhanced")


def select_memory(turns: DataFrame, kinds: DataFrame, k: int = 10, fallback: int = 5) -> DataFrame:
    """The turns that each session's kind of memory shows (``kinds``: session_id, memory_type), where no model writes summaries.

    A buffer shows all; a window, a summary buffer and the enhanced kind the last ``k``; a summary, an unknown kind and a session without
    one the last ``fallback``.
    """
    kind = F.lower(F.coalesce("memory_type", F.lit("")))
    one = kinds.groupBy("session_id").agg(F.min("memory_type").alias("memory_type"))
    shown = F.when(kind.isin(*WINDOWED), k).when(kind.isin(*WHOLE), F.lit(None)).otherwise(fallback)
    sized = turns.join(one, "session_id", "left").withColumn("_k", shown).drop("memory_type")
    last = top_per_group(sized.filter("_k IS NOT NULL"), ["session_id"], [F.desc("turn")], max(k, fallback), "_r").filter("_r <= _k").drop("_r", "_k")
    return sized.filter("_k IS NULL").drop("_k").unionByName(last)


def session_summary(turns: DataFrame, recent: int = 5, words_each: int = 3, topics: int = 5) -> DataFrame:
    """(session_id, total_turns, topics): most frequent of the first words of the last turns."""
    totals = turns.groupBy("session_id").agg(F.count("*").alias("total_turns"))
    words = top_per_group(turns, ["session_id"], [F.desc("turn")], recent, "_r").select(
        "session_id", "turn", F.posexplode(F.slice("keywords", 1, words_each)).alias("_p", "w")
    )
    counted = words.groupBy("session_id", F.lower("w").alias("w")).agg(F.count("*").alias("_n"), F.min(F.struct("turn", "_p")).alias("_seen"))
    best = top_per_group(counted, ["session_id"], [F.desc("_n"), F.asc("_seen")], topics, "_r")
    listed = best.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda s: s["w"]), ", ").alias("topics"))
    return totals.join(listed, "session_id", "left").na.fill("", ["topics"])


def memory_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(
        F.count("*").alias("total_turns"), F.sum("tokens").alias("total_tokens"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )


def clear_sessions(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    return turns.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


# --- caches ------------------------------------------------------------------------------


def cache_state(writes: DataFrame, now: Column, ttl_seconds: int, capacity: int) -> DataFrame:
    """Entries (key, ts, value) alive at ``now``: latest per key, not expired, newest ``capacity``.

    The capacity is the cache's own size; the newest rows come from a distributed top-k.
    """
    latest = writes.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    alive = latest.filter(F.unix_micros(now) - F.unix_micros("ts") <= F.lit(ttl_seconds * 1_000_000))
    return alive.orderBy(F.desc("ts"), F.asc("key")).limit(capacity)


def usage_stats(calls: DataFrame) -> DataFrame:
    """One row over a call log with tokens, seconds, cached and failed."""
    n = F.count("*")
    return calls.agg(
        n.alias("total_calls"), F.sum("tokens").alias("total_tokens"), F.round(F.sum("seconds"), 2).alias("total_time"),
        F.round(F.avg("seconds"), 2).alias("average_time"), F.count_if("cached").alias("cache_hits"), F.count_if("failed").alias("failed_calls"),
        F.round(F.count_if("cached") / n * 100, 1).alias("cache_efficiency"), F.round((n - F.count_if("failed")) / n * 100, 1).alias("success_rate"),
        F.round(F.sum("tokens") / n, 6).alias("avg_tokens_per_call"), F.round(n / F.greatest(F.sum("seconds") / 60, F.lit(1.0)), 6).alias("calls_per_minute"),
    )
