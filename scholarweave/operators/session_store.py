"""Conversation histories that are kept: versions of added turns and of cleared sessions.

A store is a folder of versions like that of the kept vectors. Appending writes the new turns, clearing writes one mark a session; the
history of a session are the turns of versions after its last mark, one row a turn, the latest. ``compact`` writes all histories as one
version, from which later reads start. A version without its ``_SUCCESS`` mark is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarweave.operators.embedding_store import version_folder, versions
from scholarweave.session import durable

TURN = "session_id string, turn long, ts timestamp, human string, ai string, tokens long, relevance double, keywords array<string>"
COLUMNS = [c.split()[0] for c in TURN.split(", ")]


def _next(spark: SparkSession, path: str) -> int:
    there = versions(spark, path)
    return there[-1][0] + 1 if there else 1


def _rows(turns: DataFrame) -> DataFrame:
    """The columns of a store; those that ``turns`` lacks are null."""
    kinds = {c.split()[0]: c.split()[1] for c in TURN.split(", ")}
    return turns.select(*[(F.col(c) if c in turns.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def append_turns(turns: DataFrame, path: str) -> int:
    """Adds turns (session_id, turn and any of the other columns): the number of the version written. Turns without a session or a number are left out."""
    spark = turns.sparkSession
    number = _next(spark, path)
    rows = _rows(turns).filter("session_id IS NOT NULL AND turn IS NOT NULL")
    rows.write.mode("overwrite").parquet(version_folder(path, number, False))
    return number


def clear_sessions(sessions: DataFrame, path: str) -> int:
    """Forgets the turns that ``sessions`` (session_id) have up to now; turns added later start a new history."""
    spark = sessions.sparkSession
    number = _next(spark, path)
    _rows(sessions.select("session_id").filter("session_id IS NOT NULL").distinct()).write.mode("overwrite").parquet(version_folder(path, number, False))
    return number


def read_histories(spark: SparkSession, path: str, sessions: DataFrame | None = None) -> DataFrame:
    """All turns that the store has now, or those of ``sessions``; a session it does not know has none."""
    rows = spark.createDataFrame([], TURN).withColumn("version", F.lit(0))
    for number, whole in versions(spark, path):
        rows = rows.unionByName(spark.read.schema(TURN).parquet(version_folder(path, number, whole)).withColumn("version", F.lit(number)))
    if sessions is not None:
        rows = rows.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    marks = rows.filter("turn IS NULL").groupBy("session_id").agg(F.max("version").alias("cleared"))
    left = rows.filter("turn IS NOT NULL").join(marks, "session_id", "left").filter("cleared IS NULL OR version > cleared")
    values = F.struct(*[c for c in COLUMNS if c not in ("session_id", "turn")])
    latest = left.groupBy("session_id", "turn").agg(F.max(F.struct("version", values.alias("v"))).alias("s"))
    return latest.select("session_id", "turn", "s.v.*")


def compact(spark: SparkSession, path: str) -> None:
    """Writes all histories as one version; earlier ones are not read any more."""
    there = versions(spark, path)
    if len(there) > 1:
        durable(read_histories(spark, path)).write.mode("overwrite").parquet(version_folder(path, there[-1][0] + 1, True))
