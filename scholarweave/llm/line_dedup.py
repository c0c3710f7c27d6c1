"""Removal of repeated runs of lines and of repeated long lines by winnowing, in DataFrame functions only.

A line is a piece between ``\\n``; it is compared without the blanks around it, and lines
of blanks only stay where they are and take no part. In every window of ``run`` lines the
smallest line hash is that window's fingerprint, so two equal windows choose the same
fingerprint at the same place. Fingerprints chosen at two places or more are shared;
only the windows that chose them go on. From a shared fingerprint a match is extended both
ways by meeting on the hash of the whole window at each offset around it: the first place
of each window (by document id, then line) is found by one aggregation and every later place is joined
to it. Windows that follow each other at both places are joined into maximal runs (``repeated_runs``), and the lines of every run are removed. So each repeated
run of ``run`` lines or more goes except where it stands first, without forming pairs.

A line of ``alone`` words or more, or of ``CHARACTERS`` in writing without blanks, is a window of its own: it goes wherever it
stands later, whatever its neighbours are. ``alone`` of None leaves runs only.

Both aggregations combine before the shuffle; the joins have stored inputs, which adaptive execution splits. Texts are read twice: for their hashes and to be cut.

Defined results: null ids or null texts are passed through and are never sources; an empty
text has one blank line. A document whose text is wholly repeated gets the text that its
blank lines leave. Rows that repeat (same id and text) are one document and all of them are kept; different
texts under one id are ordered by a hash of the text. An empty table gives an empty
result. All further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import durable, masked

RUN = 2
ALONE = 10
CHARACTERS = 100
_BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _long(line: Column, alone: int) -> Column:
    """Whether a line without blanks around it counts by itself; ten words need nineteen characters."""
    return (F.length(line) >= CHARACTERS) | ((F.length(line) >= 2 * alone - 1) & (F.size(F.split(line, f"[{_BLANK}]+")) >= alone))


def _used(lines: Column, alone: int | None = None) -> Column:
    """(number, hash, long) of the lines that are not blank."""
    trimmed = F.transform(lines, lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(_BLANK)).alias("line")))
    return F.transform(F.filter(trimmed, lambda x: x.line != ""), lambda x: F.struct(x.no.alias("no"), F.xxhash64(x.line).alias("code"), (F.lit(False) if alone is None else _long(x.line, alone)).alias("long")))


def line_codes(docs: DataFrame, run: int = RUN, alone: int | None = ALONE) -> DataFrame:
    """(doc_id, version, codes, longs): the hashes of the used lines of each text that can hold a window. Stored, so that texts are split once for all that follows."""
    known = docs.filter("doc_id is not null and text is not null")
    used = known.select("doc_id", F.xxhash64("text").alias("version"), _used(_lines(F.col("text")), alone).alias("used"))
    rows = durable(used.select("doc_id", "version", F.col("used.code").alias("codes"), F.col("used.long").alias("longs")))
    return rows.filter((F.size("codes") >= run) | F.array_contains("longs", True))


def repeated_runs(docs: DataFrame, run: int = RUN, alone: int | None = ALONE) -> DataFrame:
    """(doc_id, version, at, n, first_id, first_version, first_at): maximal runs of used lines that stand earlier, with their first place; ``at`` counts used lines from 0.

    Windows that follow each other here and at the first place of each are one run: a fingerprint's match extended both ways as far as it goes.
    """
    rows = line_codes(docs, run, alone)

    def chosen(at: Column) -> Column:
        part = F.slice("codes", at + 1, run)
        least = F.array_min(part)
        # the last place of the smallest hash: equal windows choose alike, neighbours choose the same place
        return F.struct(least.alias("mark"), (at + run - F.array_position(F.reverse(part), least)).alias("place"), at.alias("at"), F.lit(run).alias("n"), F.xxhash64(part).alias("a"), F.xxhash64(F.lit(1), part).alias("b"))

    def single(at: Column) -> Column:
        code = F.get("codes", at)
        return F.struct(code.alias("mark"), at.cast("long").alias("place"), at.alias("at"), F.lit(1).alias("n"), F.xxhash64(F.array(code)).alias("a"), F.xxhash64(F.lit(1), F.array(code)).alias("b"))

    every = F.sequence(F.lit(0), F.size("codes") - 1)
    starts = F.when(F.size("codes") >= run, F.sequence(F.lit(0), F.size("codes") - run)).otherwise(F.array().cast("array<int>"))
    made = F.transform(starts, chosen)
    if alone is not None and run > 1:
        made = F.concat(made, F.transform(F.filter(every, lambda at: F.get("longs", at)), single))
    windows = rows.select("doc_id", "version", F.explode(made).alias("w")).select("doc_id", "version", "w.*")
    # a window is counted where its place is chosen for the first time, so that the count is of places
    places = rows.select(F.explode(F.array_distinct(F.transform(made, lambda w: F.struct(w["mark"].alias("mark"), w["place"].alias("place"))))).alias("f"))
    # stored, so that the join below has two plain inputs and a common line is split
    shared = durable(places.groupBy(F.col("f.mark").alias("mark")).count().filter("count > 1").select("mark"))
    candidates = durable(windows.join(shared, "mark", "left_semi").select("a", "b", "doc_id", "version", "at", "n"))
    place = F.struct("doc_id", "version", "at")
    first = durable(candidates.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("a", "b", "first"))
    later = candidates.join(first, ["a", "b"]).filter(place > F.col("first"))
    spot = F.struct(F.col("first.doc_id").alias("id"), F.col("first.version").alias("version"), (F.col("at") - F.col("first.at")).alias("gap"), "n", "at")
    # of one text: windows by first place and distance, then by line; a break in the line numbers begins a new run
    found = later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(spot)).alias("w"))
    begins = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), F.get("w", i - 1).alias("before"), i.alias("i"))), lambda y: y.before.isNull() | ~_follows(y.x, y.before))
    cut = found.select("doc_id", "version", "w", F.transform(begins, lambda y: y.i).alias("begin"))
    ends = F.transform("begin", lambda b, k: F.coalesce(F.get("begin", k + 1), F.size("w")) - 1)
    runs = F.transform(F.arrays_zip("begin", ends.alias("end")), lambda z: F.struct(F.get("w", z["begin"]).alias("from"), F.get("w", z["end"]).alias("to")))
    return cut.select("doc_id", "version", F.explode(runs).alias("r")).select(
        "doc_id", "version", F.col("r.from.at").alias("at"), (F.col("r.to.at") - F.col("r.from.at") + F.col("r.to.n")).alias("n"),
        F.col("r.from.id").alias("first_id"), F.col("r.from.version").alias("first_version"), (F.col("r.from.at") - F.col("r.from.gap")).alias("first_at"),
    )


def _follows(x: Column, before: Column) -> Column:
    return (x["id"] == before["id"]) & (x["version"] == before["version"]) & (x["gap"] == before["gap"]) & (x["n"] == before["n"]) & (x["at"] == before["at"] + 1)


def remove_repeats(docs: DataFrame, run: int = RUN, counts: bool = True, alone: int | None = ALONE) -> DataFrame:
    """``docs`` with the repeated runs and long lines cut out of ``text``; with ``n_lines`` and ``n_removed`` if ``counts``."""
    plain, back = masked(docs, "doc_id", "text")
    found = repeated_runs(plain, run, alone).groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "n")).alias("_starts"))
    found = found.withColumnsRenamed({"doc_id": "_of", "version": "_as"})
    whole = plain.withColumn("_version", F.xxhash64("text")).join(found, (F.col("doc_id") == F.col("_of")) & (F.col("_version") == F.col("_as")), "left")
    # one projection each, so that the arrays are built once
    split = whole.withColumn("_lines", _lines(F.col("text")))
    numbered = split.withColumn("_numbers", F.when(F.col("_starts").isNotNull(), _used(F.col("_lines")).no))
    gone = numbered.withColumn("_gone", F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.slice("_numbers", s["at"] + 1, s["n"])))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    cut = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNotNull(), F.size("_lines")).otherwise(0).cast("long")
    made = gone.select(*[cut.alias(c) if c == "text" else c for c in plain.columns], n_lines.alias("_n"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_m"))
    added = {"n_lines": F.col("_n"), "n_removed": F.col("_m")} if counts else {}
    return made.select(*[c.alias(name) for name, c in (back | added).items()])
