"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the longest permitted length fills whole sequences with its front
parts; what is left of each document (one piece at most) is packed. Pieces are dealt to
shards of about ``SHARD`` pieces by a hash, and every shard is packed on its own, so no task
sees more than a bounded number of pieces however many there are.

In a shard, pieces go from long to short. A piece goes to the open sequence with the least
room that holds it, of whatever length. If there is none, a sequence is opened with the
length whose cost per token is least, where the room beside the piece counts as far as the
pieces still to come could fill it: a length costs its tokens and ``overhead`` more. At the
end each sequence is cut down to the shortest permitted length that holds its contents.

Defined results: pieces of no tokens (null or empty texts) are in no sequence. Repeated
rows are packed each. Null ids are packed as null. Ties go to the smaller id, then the
earlier part. An empty table gives no sequence. Further columns are not returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 32
SHARD = 4096

SCHEMA = "sequence_id string, capacity int, n_tokens int, doc_ids array<{id}>, starts array<bigint>, lengths array<int>"


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """(length, indices of pieces) of each sequence for ``sizes`` in falling order."""
    lengths = tuple(sorted(lengths))
    after = np.concatenate([np.cumsum(sizes[::-1])[::-1][1:], [0]]).tolist() if sizes else []
    falling = np.array(sizes)
    open_bins: dict[int, list[int]] = {}  # room -> heap of sequences
    rooms = 0  # bit r is set if a sequence has room r
    bins: list[tuple[int, list[int]]] = []
    for i, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = heapq.heappop(open_bins[room])
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[k][1].append(i)
            room -= size
        else:
            best = None
            for length in lengths:
                if length >= size:
                    room = length - size
                    # pieces after this one that are small enough to share the sequence
                    small = max(i + 1, int(np.searchsorted(-falling, -room, side="left")))
                    fill = min(room, after[small - 1] if small - 1 < len(after) else 0)
                    cost = (length + overhead) / (size + fill)
                    if best is None or cost < best[0]:
                        best = cost, length
            k, room = len(bins), best[1] - size
            bins.append((best[1], [i]))
        if room:
            heapq.heappush(open_bins.setdefault(room, []), k)
            rooms |= 1 << room
    out = []
    for _, members in bins:
        used = sum(sizes[i] for i in members)
        out.append((next(x for x in lengths if x >= used), members))
    return out


def sequences(docs: DataFrame, n_tokens: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Sequences of the documents in ``docs`` (doc_id and the column ``n_tokens``): what they hold, in order."""
    longest = max(lengths)
    rows = docs.select("doc_id", F.col(n_tokens).cast("long").alias("n")).filter("n > 0")
    # rows that repeat are counted before they are dealt out
    rows = rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    full = rows.filter(F.col("n") >= longest).select("doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / longest) - 1)).alias("part"))
    full = full.select(
        F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("copy").cast("string"), F.col("part").cast("string")).alias("sequence_id"),
        F.lit(longest).alias("capacity"), F.lit(longest).alias("n_tokens"), F.array("doc_id").alias("doc_ids"), F.array(F.col("part") * longest).alias("starts"), F.array(F.lit(longest)).alias("lengths"),
    )
    shards = max(1, -(-docs.count() // shard))
    rest = rows.withColumn("size", F.col("n") % longest).filter("size > 0")
    rest = rest.select(F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)).alias("shard"), "doc_id", (F.col("n") - F.col("size")).alias("start"), F.col("size").cast("int").alias("size"))

    def run(key, part):
        part = part.sort_by([("size", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes, starts = part.column("size").to_pylist(), part.column("start").to_pylist()
        ids = part.column("doc_id").combine_chunks()
        bins = pack(sizes, lengths, overhead)
        order = pa.array([i for _, members in bins for i in members], pa.int64())
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(m) for _, m in bins])]), pa.int32())
        shard_no = key[0].as_py()

        def grouped(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(bounds, values)

        return pa.table({
            "sequence_id": pa.array([f"{shard_no}-{k}" for k in range(len(bins))]),
            "capacity": pa.array([c for c, _ in bins], pa.int32()),
            "n_tokens": pa.array([sum(sizes[i] for i in m) for _, m in bins], pa.int32()),
            "doc_ids": grouped(ids.take(order)),
            "starts": grouped(pa.array(starts, pa.int64()).take(order)),
            "lengths": grouped(pa.array(sizes, pa.int32()).take(order)),
        })

    packed = rest.groupBy("shard").applyInArrow(run, SCHEMA.format(id=id_type))
    return packed.unionByName(full)


def word_counts(docs: DataFrame, name: str = "n_tokens") -> DataFrame:
    """``doc_id`` and the number of words ``[^\\x20\\x09-\\x0D]+`` of each text, the length used where no tokenizer is given."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    return docs.select("doc_id", F.coalesce(F.size(words), F.lit(0)).cast("long").alias(name))
