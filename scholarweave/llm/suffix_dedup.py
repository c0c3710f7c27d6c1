"""Removal of passages that stand in an earlier document, by groups of suffixes with a common prefix.

Of prefix-partitioned suffix trees this keeps the partition by prefixes of growing length; the subtrees are replaced by hashes of their nodes: no
suffix is sorted and no tree is laid out, since a tree per group would have to carry the words of every suffix.

The suffixes of a text start at its words. A repeated passage of ``window`` words is a node
of the suffix tree at that depth with two documents below it. The tree is never built in one
piece: suffixes meet in groups by a prefix, and a group's prefix is made longer where it is shared.

1. Short prefixes. Of the 14-word prefixes inside each window the one with the
   smallest hash is the window's anchor, so equal windows have the same anchor at the same
   offset and about one suffix in 19 is an anchor. Anchors are counted by prefix with the smallest and
   largest document below; a prefix that stays inside one document has no deep shared node and its group ends here.
2. Longer prefixes. Where a prefix is shared its windows go on with anchors of 38 words, counted alike, and where these are shared
   with the whole window as prefix: those groups are the deep internal nodes. Successive windows with one short anchor are one
   edge of the tree, kept as one row: an edge that a smaller document has too is marked whole and never taken apart. A node needs
   no memory beyond its smallest document, which one combining aggregation finds, so a node that a third of all documents share is no hot group.
3. Every suffix below a node with a smaller document marks its window; the union of the marked windows is removed.

Documents of equal words are one to begin with: the smallest id stands for them, and each
other one is wholly removed if it has a window at all.

Defined results: null texts have no words, null ids are kept whole and are never sources. Repeated rows of
one id do not remove each other. Prefixes and nodes are told apart by 64-bit and 128-bit hashes of word hashes.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns, durable, join_lists
from scholarweave.llm.words import Words, covered, mix, per_row, slices

WINDOW = 50
PREFIXES = (14, 38)  # words; each longer one is tried only below the shorter ones that are shared
_SALT = np.uint64(0xE7037ED1A0B428DB)


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, 64-bit node hash, anchor prefix hash and anchor place of each window."""
    running = words.running()
    at, node = words.window_codes(window, running)
    start, code = words.window_codes(prefix, running)
    if not len(at):
        return at, node, node, at
    by_word = np.full(len(words), np.iinfo(np.uint64).max, dtype=np.uint64)
    by_word[start] = code
    # the smallest of `span` neighbours, by doubling: the least of two overlapping powers of two
    span = window - prefix + 1
    power = 1 << (span.bit_length() - 1)
    least, step = by_word, 1
    while step < power:
        least = np.minimum(least, np.concatenate([least[step:], np.full(step, least[-1])])) if step < len(least) else least
        step *= 2
    chosen = np.minimum(least[at], least[at + span - power])
    return at, node, chosen, at


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, hash of the whole word sequence, digest of the words, distinct anchor prefixes."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n_words, one, two, digest, marks = [], [], [], [], []
        for a, b, buf, bounds in slices(_text(batch)):
            words = Words(buf, bounds)
            n_words.append(words.counts())
            total, down = words.running()
            f, e = words.first[:-1], words.first[1:]
            whole = (total[e] - total[f]) * down[f]
            one.append(mix(whole + words.counts().astype(np.uint64)))
            extra = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.code ^ _SALT) * (np.arange(len(words), dtype=np.uint64) - np.repeat(f, words.counts()).astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
            two.append(mix(extra[e] - extra[f]))
            at, _, chosen, _ = anchors(words, window, PREFIXES[0])
            row = words.row_of()[at]
            new = np.ones(len(at), dtype=bool)  # neighbours mostly choose the same anchor
            new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
            kept, owner = chosen[new].view(np.int64), row[new]
            cut = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
            first = words.first.tolist()
            for i in range(b - a):
                marks.append(kept[cut[i] : cut[i + 1]])
                digest.append(hashlib.sha256(words.joined(first[i], first[i + 1])).hexdigest())
        return {
            "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), "words_one": pa.array(np.concatenate(one).view(np.int64) if one else [], pa.int64()),
            "words_two": pa.array(np.concatenate(two).view(np.int64) if two else [], pa.int64()), "words_sha256": pa.array(digest, pa.string()), "marks": pa.array(marks, pa.list_(pa.int64())),
        }

    return add_columns(docs, work, "n_words bigint, words_one bigint, words_two bigint, words_sha256 string, marks array<bigint>", ["doc_id"], ["text"])


def _candidates(batch: pa.RecordBatch, window: int, prefix: int):
    """For each slice: its first row, words, starts and nodes of the windows whose anchor is listed in the row's ``shared``, their anchors and rows."""
    shared = batch.column(batch.schema.get_field_index("shared"))
    salt = np.uint64(0x632BE59BD9B4E019)
    for a, b, buf, bounds in slices(_text(batch)):
        words = Words(buf, bounds)
        at, node, chosen, _ = anchors(words, window, prefix)
        row = words.row_of()[at]
        lists = shared.slice(a, b - a)
        allowed, owner = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
        good = np.isin(chosen ^ (row.astype(np.uint64) * salt), allowed ^ (owner.astype(np.uint64) * salt))
        yield a, words, at[good], node[good], chosen[good], row[good]


def _longer(docs: DataFrame, window: int, prefix: int, longer: int) -> DataFrame:
    """(doc_id, prefix): the ``longer`` anchors of the windows of ``docs`` (doc_id, text, shared) whose ``prefix`` anchor is in ``shared``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, words, at, _, _, row in _candidates(batch, window, prefix):
                every, _, chosen, _ = anchors(words, window, longer)
                mark = chosen[np.searchsorted(every, at)]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[new] + a)), pa.array(mark[new].view(np.int64))], names=["doc_id", "prefix"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, prefix bigint")


def _runs(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc_id, at, run, prefix, nodes): successive windows with one short anchor, as one row each.

    Only windows of ``docs`` (doc_id, text, shared) whose ``prefix`` anchor is in ``shared``. ``run`` is the
    hash of all words from the first window to the last, ``nodes`` has the hash of each window.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, words, at, node, _, row in _candidates(batch, window, prefix):
                if not len(at):
                    continue
                every, _, chosen, _ = anchors(words, window, PREFIXES[0])
                mark = chosen[np.searchsorted(every, at)]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(at)]]) - 1
                total, down = words.running()
                s, e = at[first], at[last] + window
                whole = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row[first] + a)), pa.array((s - words.first[row[first]]).astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(mark[first].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(at)]]).astype(np.int32)), pa.array(node.view(np.int64))),
                    ],
                    names=["doc_id", "at", "run", "prefix", "nodes"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at int, run bigint, prefix bigint, nodes array<bigint>")


def _lowest(rows: DataFrame, *keys: str) -> DataFrame:
    """The smallest document of each key that two documents have; stored, so that a join with it meets two plain shuffles."""
    return durable(rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select(*keys, "low"))


def _shared_lists(marks: DataFrame) -> DataFrame:
    """(doc_id, shared): of each document's prefixes those that a second document has. ``marks``: doc_id, prefix."""
    # stored, so that the join below meets two plain shuffles, which adaptive execution can split
    shared = durable(marks.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("prefix"))
    return durable(marks.join(shared, "prefix").groupBy("doc_id").agg(F.collect_set("prefix").alias("shared")))


def marked_windows(docs: DataFrame, profile: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts): the windows of each document that also start in a smaller document, as first words and numbers of successive windows.

    Only documents that stand for their words are looked at; ``profile`` is the stored ``_profile`` of ``docs``.
    """
    whole = profile.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # a document under one id can have several texts: the texts are then searched one by one
    firsts = whole.groupBy("words_one", "words_two", "n_words").agg(F.min("doc_id").alias("doc_id"), F.first("marks").alias("marks"))
    lists = _shared_lists(firsts.select("doc_id", F.explode(F.array_distinct("marks")).alias("prefix")))
    plain = docs.select("doc_id", "text")
    for prefix, longer in pairwise(PREFIXES):
        lists = _shared_lists(durable(_longer(join_lists(plain, lists, "doc_id", "shared", 8), window, prefix, longer).distinct()))
    runs = _runs(join_lists(plain, lists, "doc_id", "shared", 8), window, PREFIXES[-1])
    # a run that a smaller document has too is marked whole, and is no source: that document is a better one
    known = durable(runs.join(_lowest(runs, "run", "prefix"), ["run", "prefix"], "left"))
    whole = known.filter("doc_id > low").select("doc_id", "at", F.size("nodes").alias("n"))
    first = known.filter("low is null or doc_id = low").select("doc_id", "at", "prefix", F.posexplode("nodes").alias("i", "node"))
    single = first.join(_lowest(first, "node", "prefix"), ["node", "prefix"]).filter("doc_id > low").select("doc_id", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("starts"))


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null where nothing was removed) of each document."""
    profile = durable(_profile(docs.select("doc_id", "text"), window))
    starts = durable(marked_windows(docs, profile, window))
    texts = join_lists(docs.select("doc_id", "text"), starts, "doc_id", "starts", 32)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        removed, digest, kept, whole = [], [], [], []
        lists = batch.column(batch.schema.get_field_index("starts"))
        for a, b, buf, bounds in slices(_text(batch)):
            words = Words(buf, bounds)
            part = lists.slice(a, b - a)
            spans, owner = part.flatten(), np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
            at, length = spans.field("at").to_numpy(), spans.field("n").to_numpy() + window - 1
            inside = at + length <= words.counts()[owner]  # a shorter text under the same id has no such window
            gone = covered(len(words), words.first[owner[inside]] + at[inside], length[inside])
            removed.append(per_row(gone, words.first))
            first = words.first.tolist()
            raw = buf.tobytes()
            left = np.flatnonzero(~gone)
            cut = np.searchsorted(left, words.first).tolist()
            s, e = words.start[left].tolist(), words.end[left].tolist()
            for i in range(len(first) - 1):
                text = b" ".join([raw[x:y] for x, y in zip(s[cut[i] : cut[i + 1]], e[cut[i] : cut[i + 1]], strict=True)])
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
                whole.append(hashlib.sha256(words.joined(first[i], first[i + 1])).hexdigest())
        return {"words_sha256": pa.array(whole, pa.string()), "removed": pa.array(np.concatenate(removed) if removed else [], pa.int64()), "digest": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.string())}

    cut = add_columns(texts, work, "words_sha256 string, removed bigint, digest string, kept string", ["doc_id"], ["text", "starts"])
    cut = cut.dropDuplicates(["doc_id", "words_sha256"])
    low = _lowest(profile.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)), "words_one", "words_two", "n_words")
    low = low.select(F.col("words_one").alias("_one"), F.col("words_two").alias("_two"), F.col("n_words").alias("_n"), "low")
    same = (F.col("words_one") == F.col("_one")) & (F.col("words_two") == F.col("_two")) & (F.col("n_words") == F.col("_n"))
    rows = profile.select("doc_id", "n_words", "words_one", "words_two", "words_sha256").join(low, same, "left")
    copies = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    rows = rows.select("doc_id", "n_words", "words_sha256", copies.alias("copy")).join(cut, ["doc_id", "words_sha256"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("digest", "words_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
