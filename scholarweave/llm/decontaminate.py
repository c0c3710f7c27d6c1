"""Removal of documents that hold passages of a benchmark.

Windows of ``window`` words of every benchmark item (all its words if it has fewer) go into a
hash set that is shipped to the tasks. It holds at most ``SET_WORDS`` words of items at a
time: a larger benchmark is dealt into parts by item and the documents are scanned once for each
part, with the findings so far stored in between. Each scan looks the hashes of all windows of a text up in
the set and compares the words themselves wherever a hash is found.

Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased.

Defined results: null texts and items without words have no windows, items without an id are left out;
rows of one item id are one item. Repeated documents are judged each. An empty
table of documents or items gives no hits. All columns of the documents may be kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns, durable, masked, restored
from scholarweave.llm.words import LOWER, NO_WORD, Words, covered, row_buffer, slices

WINDOW = 10
SET_WORDS = 1_000_000

_FOUND = "_hit_spans array<int>, _hit_items array<string>, _n_words bigint"


class WindowSet:
    """Windows of items: length -> sorted hashes, and hash -> [(words, items)]."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        self.known: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        buf, bounds = row_buffer(texts)
        words = Words(LOWER[buf], bounds, NO_WORD)
        counts, running = words.counts(), words.running()
        for length in sorted({int(min(n, window)) for n in counts if n}):
            at, code = words.window_codes(length, running)
            row = words.row_of()[at]
            own = np.minimum(counts[row], window) == length
            hashed = self.known.setdefault(length, {})
            for place, key, item in zip(at[own].tolist(), code[own].tolist(), row[own].tolist(), strict=True):
                hashed.setdefault(key, {}).setdefault(words.joined(place, place + length), set()).add(ids[item])
        self.codes = {length: np.array(sorted(hashed), dtype=np.uint64) for length, hashed in self.known.items()}
        self.bits = {}
        for length, codes in self.codes.items():
            self.bits[length] = np.zeros(1 << 20, dtype=bool)
            self.bits[length][(codes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
        """(first word, length) of the verified windows, and the items found in each row."""
        spans, items = [], {}
        running = words.running()
        rows = words.row_of()
        for length, codes in self.codes.items():
            at, code = words.window_codes(length, running)
            maybe = np.flatnonzero(self.bits[length][(code & np.uint64((1 << 20) - 1)).astype(np.int64)])
            maybe = maybe[np.isin(code[maybe], codes)]
            for place, key in zip(at[maybe].tolist(), code[maybe].tolist(), strict=True):
                found = self.known[length][key].get(words.joined(place, place + length))
                if found:
                    spans.append((place, length))
                    items.setdefault(int(rows[place]), set()).update(found)
        return spans, items


def scan(column: pa.Array, known: WindowSet) -> dict[str, pa.Array]:
    """Hit spans (from, to in words, pairwise), items and word counts of each text."""
    spans_out, items_out, n_words = [], [], []
    for a, b, buf, bounds in slices(column):
        words = Words(LOWER[buf], bounds, NO_WORD)
        spans, items = known.hits(words)
        hit = covered(len(words), np.array([s for s, _ in spans], dtype=np.int64), np.array([n for _, n in spans], dtype=np.int64)) if spans else np.zeros(len(words), dtype=bool)
        first = words.first.tolist()
        for row in range(b - a):
            if row in items:
                own = np.concatenate([[False], hit[first[row] : first[row + 1]], [False]])
                spans_out.append(np.flatnonzero(own[1:] != own[:-1]).tolist())
                items_out.append(sorted(items[row]))
            else:
                spans_out.append([])
                items_out.append([])
        n_words.append(words.counts())
    return {"_hit_spans": pa.array(spans_out, pa.list_(pa.int32())), "_hit_items": pa.array(items_out, pa.list_(pa.string())), "_n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64())}


def benchmark_parts(benchmark: DataFrame, window: int = WINDOW, set_words: int = SET_WORDS):
    """Window sets of bounded size that together hold all items; one driver-side set at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // (2 * set_words)))  # a word and its separator take two characters at least
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        if len(rows) or part == 0:
            yield WindowSet(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks() if len(rows) else pa.array([], pa.string()), window)


def _merge_spans(old: list[int], new: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(old[::2], old[1::2], strict=True), *zip(new[::2], new[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def findings(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, set_words: int = SET_WORDS) -> DataFrame:
    """``keep`` columns of each document with ``_hit_spans`` (word bounds), ``_hit_items`` (sorted) and ``_n_words``."""
    spark = docs.sparkSession
    made: DataFrame | None = None
    for part in benchmark_parts(benchmark, window, set_words):
        shipped = spark.sparkContext.broadcast(part)
        before = made is not None

        def work(batch: pa.RecordBatch, shipped=shipped, before=before) -> dict[str, pa.Array]:
            new = scan(batch.column(batch.schema.get_field_index("text")), shipped.value)
            if before:
                old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_hit_spans", "_hit_items")]
                new["_hit_spans"] = pa.array([_merge_spans(o, n) for o, n in zip(old[0], new["_hit_spans"].to_pylist(), strict=True)], pa.list_(pa.int32()))
                new["_hit_items"] = pa.array([sorted({*o, *n}) for o, n in zip(old[1], new["_hit_items"].to_pylist(), strict=True)], pa.list_(pa.string()))
            return new

        carried = list(dict.fromkeys([*keep, "text"]))
        source = docs if made is None else durable(made)
        made = add_columns(source, work, _FOUND, carried, ["text", *(("_hit_spans", "_hit_items") if before else ())])
    return made.select(*keep, "_hit_spans", "_hit_items", "_n_words")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts of each document."""
    spans = F.col("_hit_spans")
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda total, x: total + x)
    return findings(docs, benchmark, ["doc_id"], **options).select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit_items", ","), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"), "_hit_spans", "_hit_items",
    ).withColumnsRenamed({"_hit_spans": "hit_spans", "_hit_items": "hit_items"})


def remove(docs: DataFrame, benchmark: DataFrame, action: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``spans``) without the hit words in their texts.

    Cutting spans can bring words together that were apart; cut words leave a blank line in their place.
    """
    plain, back = masked(docs, "text")
    found = findings(plain, benchmark, plain.columns, **options)
    if action == "documents":
        return restored(found.filter(F.size("_hit_spans") == 0), back)
    names = plain.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at), batch.column(batch.schema.get_field_index("_hit_spans")).to_pylist()
            new = texts.to_pylist()
            for i, cuts in enumerate(spans):
                if cuts:
                    buf, bounds = row_buffer(texts.slice(i, 1))
                    words, raw, pieces, last = Words(LOWER[buf], bounds, NO_WORD, hashed=False), buf.tobytes(), [], 0
                    for s, e in zip(cuts[::2], cuts[1::2], strict=True):
                        pieces.append(raw[last : words.start[s]])
                        last = words.end[e - 1]
                    new[i] = b"\n\n".join([*pieces, raw[last:]]).decode()
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return restored(found.mapInArrow(run, plain.schema), back)
