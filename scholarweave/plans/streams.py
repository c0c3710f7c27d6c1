"""Catalogue: keyed state over streams of the conversation and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarweave.session import scratch
from scholarweave.streaming import kept, state


def stream_sessions(spark, d):
    """Every turn of a conversation is a memory entry of its session."""
    rows = state.read_table_stream(spark, d, "conversations")
    turns = rows.select(F.concat_ws("-", F.lit("c"), "conv_id").alias("session_id"), "turn", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    return state.run_to_table(state.session_memory(turns, max_tokens=400, max_turns=5), "sessions")


def stream_cache(spark, d):
    rows = state.read_table_stream(spark, d, "events")
    calls = rows.select(F.concat_ws("-", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out = state.run_to_table(state.cached_calls(calls, 24 * 3600), "cache")
    return out.groupBy("key").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"))


def stream_kept_cache(spark, d):
    """Every user's cache of answers by event type: the first half of the month, a stop, and a start from the stored state for the rest."""
    rows = state.read_table_stream(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    calls = rows.select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("key"), ts.alias("ts"), F.col("event_id").cast("string").alias("value"))
    path, half = scratch(spark, "answers"), F.timestamp_seconds(F.lit(1705276800))
    kept.run_calls(calls.filter(F.col("ts") < half), path, 24 * 3600, 3, 1)
    kept.compact(spark, path)
    out = kept.run_calls(calls.filter(F.col("ts") >= half), path, 24 * 3600, 3, 1)
    return out.groupBy("owner", "key").agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"))


QUERIES = {f.__name__: f for f in (stream_sessions, stream_cache, stream_kept_cache)}
SQL = {
    "stream_kept_cache": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS owner, event_type AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS rn FROM events),
w(owner, key, rn, hit, h) AS (SELECT owner, key, rn, false, [{'k': key, 'b': ts}] FROM e WHERE rn = 1
  UNION ALL SELECT owner, key, rn, hit, CASE WHEN hit THEN live WHEN len(live) >= 3 THEN list_append(live, {'k': key, 'b': ts})[2:] ELSE list_append(live, {'k': key, 'b': ts}) END
  FROM (SELECT e.*, live, list_contains(list_transform(live, lambda x: x.k), e.key) AS hit
    FROM (SELECT w.owner, w.rn + 1 AS n, e.ts AS now, list_filter(h, lambda x: e.ts - x.b < INTERVAL 24 HOUR) AS live FROM w JOIN e ON e.owner = w.owner AND e.rn = w.rn + 1) s
    JOIN e ON e.owner = s.owner AND e.rn = s.n))
SELECT owner, key, count(*) AS calls, count(*) FILTER (hit) AS hits FROM w GROUP BY 1, 2""",
    "stream_cache": """WITH RECURSIVE e AS (SELECT user_id || '-' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
w(key, rn, born, hit) AS (SELECT key, rn, ts, false FROM e WHERE rn = 1
  UNION ALL SELECT e.key, e.rn, CASE WHEN e.ts - w.born < INTERVAL 24 HOUR THEN w.born ELSE e.ts END, e.ts - w.born < INTERVAL 24 HOUR FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, count(*) AS calls, count(*) FILTER (hit) AS hits FROM w GROUP BY 1""",
    "stream_sessions": """WITH RECURSIVE t AS (SELECT 'c-' || conv_id AS session_id, turn, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
w(session_id, turn, rn, h, sq) AS (SELECT session_id, turn, rn, [tokens], tokens > 400 FROM t WHERE rn = 1
  UNION ALL SELECT t.session_id, t.turn, t.rn, CASE WHEN list_sum(list_append(h, t.tokens)) > 400 OR len(h) + 1 > 5
      THEN list_append(h, t.tokens)[-greatest(3, CAST(floor((len(h) + 1) * 0.3) AS BIGINT)):] ELSE list_append(h, t.tokens) END,
    list_sum(list_append(h, t.tokens)) > 400 OR len(h) + 1 > 5 FROM w JOIN t ON t.session_id = w.session_id AND t.rn = w.rn + 1)
SELECT session_id, turn, CAST(len(h) AS INTEGER) AS kept_turns, CAST(list_sum(h) AS BIGINT) AS kept_tokens, sq AS compressed FROM w""",
}
