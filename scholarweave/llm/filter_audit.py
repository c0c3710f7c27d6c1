"""What filters remove, in every order in which they can be applied, counted by a stream that takes back what it learns was wrong.

A folder of documents is read as a stream of available-now micro-batches. The conditions that a text decides alone become a mask of bits.
Whether a text stands in a document with a smaller id is kept in keyed state: for each text (its SHA-256) the smallest id seen so far, and
how the rows of that id are counted. Every row is counted at once, under the mask that holds for what was seen; when a smaller id arrives
in a later batch, the count of the former holder is taken back and given to the mask with the duplicate bit. The stream's output
are these changes of part counters; their sum is a table of (part, mask, good, toxic) with at most 32 masks a part,
from which all orders and steps are worked out.

State is held by groups of texts that share the first bits of their hash; there are so many groups that each has some
hundreds of texts, whatever the size of the corpus. Copies are added up in every task before they are shuffled, so a text that a third of all
documents share sends a few rows from each task. Progress, state and changes are in the shared folder: a lost executor
costs its tasks only.

Defined results: a null text is an empty one. A null id is neither smaller than another nor has it smaller ones, so its row never fails as a
duplicate. Rows that repeat an id with one text are counted each. A document is good (toxic) if any of its label rows says so; without one
it is neither. A null part is the empty string. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarweave.session import scratch

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
BATCHES = 8
TEXTS_IN_STATE = 512
_BLANK = r"[\x20\x09-\x0D]+"
_COUNTERS = ["part", "mask", "good", "toxic"]
_ROWS = "bucket bigint, sha binary, id bigint, part string, mask int, good boolean, toxic boolean, n bigint"


def with_conditions(docs: DataFrame) -> DataFrame:
    """``docs`` (id, part, text) with ``mask``: the bits of the conditions A to D that a text fails; ``text`` gives way to ``sha``."""
    text = F.coalesce("text", F.lit(""))
    # one projection each, so that the words are split once
    split = docs.select("id", "part", text.alias("text")).withColumn("words", F.filter(F.split("text", _BLANK, -1), lambda w: w != ""))
    counted = split.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.length("text").alias("chars"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"), F.col("text").rlike(r"[#$%&*|]").alias("marks"),
    )
    n, distinct, chars, capitals = (F.col(c).cast("long") for c in ("n", "distinct", "chars", "capitals"))
    failed = n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * chars, F.col("marks")
    return counted.select("id", "part", "sha", sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)).alias("mask"))


def _sum_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch added up: of a text only the smallest id keeps its row, all others surely have a smaller one."""
    for batch in batches:
        df = batch.to_pandas(types_mapper=pd.ArrowDtype)
        least = df.groupby("sha")["id"].transform("min")
        later = (df["id"] > least).fillna(False).astype(bool)
        df.loc[later, "mask"] = df.loc[later, "mask"] | DUPLICATE
        lost = later | df["id"].isna()  # these need no state
        df.loc[lost, "sha"] = None
        df.loc[lost, "id"] = 0  # not null: a column with nulls reaches ``_update`` as floats, which round large ids
        summed = df.groupby(["bucket", "sha", "id", *_COUNTERS], dropna=False, sort=False)["n"].sum().reset_index()
        yield pa.RecordBatch.from_pandas(summed, schema=batch.schema, preserve_index=False)


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counters' changes from the new rows of a group of texts, and the group's new state."""
    held: dict[bytes, tuple[int, Counter]] = {}  # of each text the smallest id and what is counted of it
    for sha, id_, *of, n in state.get[0] if state.exists else ():
        held.setdefault(bytes(sha), (id_, Counter()))[1][tuple(of)] += n
    changes: Counter = Counter()

    def count_as_copies(counted: Counter) -> None:
        for (part, mask, good, toxic), n in counted.items():
            changes[part, mask | DUPLICATE, good, toxic] += n

    for new in parts:
        for sha, id_, n, *of in zip(*(new[c].tolist() for c in ("sha", "id", "n", *_COUNTERS)), strict=True):
            one = Counter({tuple(of): n})
            if sha is None:
                changes.update(one)
                continue
            sha = bytes(sha)
            least, counted = held.get(sha, (None, None))
            if least is not None and id_ > least:
                count_as_copies(one)
                continue
            changes.update(one)
            if id_ == least:
                counted.update(one)
                continue
            if least is not None:
                changes.subtract(counted)
                count_as_copies(counted)
            held[sha] = id_, one
    state.update(([(sha, id_, *of, n) for sha, (id_, counted) in held.items() for of, n in counted.items()],))
    rows = [(*of, n) for of, n in changes.items() if n]
    yield pd.DataFrame(rows, columns=[*_COUNTERS, "n"]).astype({"mask": "int32", "good": "bool", "toxic": "bool", "n": "int64"})


def counters(spark: SparkSession, folder: str, labels: DataFrame, columns: dict[str, str], batches: int = BATCHES) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail. ``columns`` names those of ``id``, ``part`` and ``text`` in the table at ``folder``.

    ``labels``: id, quality, toxic. ``batches`` is the number of micro-batches that the files are dealt over.
    """
    table = spark.read.parquet(folder)
    files, n = len(table.inputFiles()), table.count()
    buckets = max(1, -(-n // TEXTS_IN_STATE))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).option("maxFileAge", "100000d").parquet(f"{folder[:-1]}[{folder[-1]}]")  # a pattern, so that it may be one file or a folder of files
    docs = stream.select(F.col(columns["id"]).cast("long").alias("id"), F.coalesce(F.col(columns["part"]), F.lit("")).alias("part"), F.col(columns["text"]).alias("text"))
    known = labels.filter("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = with_conditions(docs).join(known, "id", "left").select(
        F.pmod(F.xxhash64("sha"), F.lit(buckets)).alias("bucket"), "sha", "id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), F.lit(1).cast("long").alias("n"),
    )
    changes = rows.mapInArrow(_sum_copies, _ROWS).groupBy("bucket").applyInPandasWithState(
        _update, "part string, mask int, good boolean, toxic boolean, n bigint",
        "texts array<struct<sha: binary, id: bigint, part: string, mask: int, good: boolean, toxic: boolean, n: bigint>>", "append", GroupStateTimeout.NoTimeout,
    )
    out = scratch(spark, "filter-audit")
    writer = changes.writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{out}/changes").groupBy(*_COUNTERS).agg(F.sum("n").alias("n")).filter("n <> 0")


def _steps() -> Column:
    """All orders and steps as one literal array: the filter's bit and the bits of those before it."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from ``counters``."""
    rows = counted.select("*", F.explode(_steps()).alias("s")).select("part", "mask", "good", "toxic", "n", "s.*")
    n, mask, bit, before = F.col("n"), F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(when: Column, amount: Column = n) -> Column:
        return F.sum(F.when(when, amount).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(mask.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(fails & ~earlier & F.col("good")).alias("good_lost"), total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
        # of the orders in which a document fails k filters, each of the k is first in the same share
        total(fails, n * F.lit(len(list(itertools.permutations(FILTERS)))) / F.bit_count(mask)).alias("shapley"),
    )
