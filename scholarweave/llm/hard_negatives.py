"""Hard negatives of anchor vectors by exact integer products in tiles.

Vectors are turned into integers. Anchors and candidates are dealt by a hash into blocks of bounded size, and every block of
anchors meets every block of candidates in one cell of a grid, once: an anchor is sent to each block of candidates and a
candidate to each block of anchors. Inside a cell the scores are computed in tiles by Strassen's recursive
multiplication on int64 (tiles are padded with zeros to even sides; sums and products are exact modulo 2**64, so a score that
fits is right). A cell keeps heaps only: pass one the best ``positives`` of the same label for each anchor, pass two, once those
scores are known, the best ``negatives`` of another label within the window of each positive. Heaps of cells are
merged by a ranking per anchor that Spark cuts on the map side. No score matrix leaves a task.

Every row is compared with every anchor, as the query set asks; the work is anchors x rows, the shuffle is rows x blocks of anchors.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. An empty vector is
one with score 0. Vectors of another length than the partner's are padded with zeros. Rows that repeat (same id,
label and vector) are one row; rows with the anchor's own id are never its partners. An anchor without positives or
without rows in a window has no rows. Scores that might not fit 64 bits fail the job. An empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarweave.llm.common import durable

LEAF = 64


@dataclass(frozen=True)
class Settings:
    """Scores of negatives lie between ``low`` and ``high`` percent of the positive's. ``anchors`` and ``rows`` are the sides of a cell, ``tile`` that of a product."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    anchors: int = 2048
    rows: int = 8192
    tile: int = 512


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices modulo 2**64; below ``leaf`` a plain product."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf // 4 or max(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), dtype=np.int64)
    out[:x, :z] = p1 + p4 - p5 + p7
    out[:x, z:] = p3 + p5
    out[x:, :z] = p2 + p4
    out[x:, z:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, v array<long>): floor(scale * x) of every component, for the rows that take part; each once."""
    whole = F.transform("v", lambda x: x.cast("double") * F.lit(float(scale)))
    fits = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter("id is not null and label is not null and v is not null").filter(fits)
    out_of_range = F.exists(whole, lambda x: F.abs(x) >= F.lit(2.0**62))
    floors = F.transform(whole, lambda x: F.floor(x).cast("long"))
    return rows.select("id", "label", F.when(out_of_range, F.raise_error(F.lit("a component does not fit 64 bits"))).otherwise(floors).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _widest(*columns: pa.ChunkedArray) -> int:
    return max([1, *(int(n) for c in columns if len(c) for n in [np.diff(c.combine_chunks().offsets.to_numpy()).max()])])


def _tiles(left: pa.Table, right: pa.Table, tile: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of all rows of ``left`` with all of ``right``, in tiles."""
    width = _widest(left["v"], right["v"])
    a, b = _matrix(left["v"], width), _matrix(right["v"], width)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if bound * 100 >= 2.0**62:  # percentages of a score are compared too
        raise OverflowError(f"scores up to {bound:g} do not fit 64 bits")
    b = np.ascontiguousarray(b.T)
    for i in range(0, len(a), tile):
        for j in range(0, b.shape[1], tile):
            yield slice(i, i + tile), slice(j, j + tile), strassen(a[i : i + tile], b[:, j : j + tile])


_NONE, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Heaps:
    """The best ``k`` (score, then smaller id) for each of ``n`` rows. Tiles are pushed in ascending order of ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE, dtype=np.int64)
        self.id = np.full((n, k), _NO_ID, dtype=np.int64)

    def push(self, rows: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        # an equal score met later has a larger id and stays out of a full heap
        at, column = np.nonzero(allowed & (scores > self.score[rows, -1:]))
        if not len(at):
            return
        found, names = scores[at, column], ids[column]
        order = np.lexsort((names, ~found, at))
        at, found, names = at[order], found[order], names[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        best = place < self.k
        fresh_score, fresh_id = np.full((len(scores), self.k), _NONE), np.full((len(scores), self.k), _NO_ID)
        fresh_score[at[best], place[best]], fresh_id[at[best], place[best]] = found[best], names[best]
        both, both_id = np.concatenate([self.score[rows], fresh_score], 1), np.concatenate([self.id[rows], fresh_id], 1)
        order = np.lexsort((both_id, ~both), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all that is in the heaps."""
        row, place = np.nonzero(self.score != _NONE)
        return row, self.score[row, place], self.id[row, place]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _best_positives(left: pa.Table, right: pa.Table, settings: Settings) -> pa.Table:
    right = right.sort_by("id")
    label, other, ids, own = _numbers(left, "label"), _numbers(right, "label"), _numbers(right, "id"), _numbers(left, "id")
    heaps = Heaps(len(left), settings.positives)
    for a, b, scores in _tiles(left, right, settings.tile):
        heaps.push(a, scores, (label[a, None] == other[None, b]) & (own[a, None] != ids[None, b]), ids[b])
    row, score, found = heaps.entries()
    return pa.table({"anchor_id": own[row], "key": _numbers(left, "key")[row], "score": score, "id": found})


def _best_negatives(left: pa.Table, right: pa.Table, settings: Settings) -> pa.Table:
    right = right.sort_by("id")
    label, other, ids, own = _numbers(left, "label"), _numbers(right, "label"), _numbers(right, "id"), _numbers(left, "id")
    positives = left["positives"].combine_chunks()
    counts, first = np.diff(positives.offsets.to_numpy()), positives.offsets.to_numpy()[:-1] - positives.offsets[0].as_py()
    score_of, id_of = (positives.flatten().field(i).to_numpy() for i in (0, 1))
    slots = int(counts.max(initial=0))
    heaps = [Heaps(len(left), settings.negatives) for _ in range(slots)]
    for a, b, scores in _tiles(left, right, settings.tile):
        different, percent = (label[a, None] != other[None, b]) & (own[a, None] != ids[None, b]), scores * 100
        for slot, heap in enumerate(heaps):
            has = counts[a] > slot
            bar = np.where(has, score_of[np.where(has, first[a] + slot, 0)], 0)[:, None]
            heap.push(a, scores, has[:, None] & different & (settings.low * bar <= percent) & (percent <= settings.high * bar), ids[b])
    parts = []
    for slot, heap in enumerate(heaps):
        row, score, found = heap.entries()
        of = first[row] + slot
        parts.append(pa.table({
            "anchor_id": own[row], "key": _numbers(left, "key")[row], "slot": np.full(len(row), slot), "positive_id": id_of[of],
            "positive_score": score_of[of], "score": score, "id": found,
        }))
    return pa.concat_tables(parts)  # an anchor that comes here has a positive, so there is a slot


def _grid(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on every cell: each block of anchors with each block of rows."""
    own = F.pmod(F.xxhash64("id", "v"), F.lit(blocks[0])), F.pmod(F.xxhash64("id", "v"), F.lit(blocks[1]))
    left = anchors.withColumn("_a", own[0]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1)).cast("array<long>")))
    right = rows.withColumn("_b", own[1]).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1)).cast("array<long>")))

    shape = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a, b).cast(shape) if len(a) and len(b) else shape.empty_table()

    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides come from one table; new columns tell them apart
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(cell, schema)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``rank`` 1 to ``k`` by score, then id, for each key; Spark keeps the best of every task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (id, label, v of integers, see ``integers``).

    ``is_anchor`` is a condition on ``id``.
    """
    rows = durable(vectors.select("id", F.col("label").cast("long").alias("label"), "v"))
    anchors = rows.filter(is_anchor).withColumn("key", F.xxhash64("id", "label", "v"))
    n_rows, n_anchors, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    wide = max(1, width // 512)  # long vectors make smaller cells
    blocks = tuple(max(1, -(-n * wide // side)) for n, side in ((n_anchors, settings.anchors), (n_rows, settings.rows)))
    found = _grid(anchors, rows, blocks, lambda a, b: _best_positives(a, b, settings), "anchor_id long, key long, score long, id long")
    best = _first(found, ["anchor_id", "key"], settings.positives)
    windows = best.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("n"), "score", "id"))).alias("p"))
    # in order of rank; at most ``positives`` of them
    windows = durable(windows.select(F.col("anchor_id").alias("id"), "key", F.transform(F.reverse("p"), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives")))
    second = _grid(
        anchors.join(windows, ["id", "key"]), rows, blocks, lambda a, b: _best_negatives(a, b, settings),
        "anchor_id long, key long, slot long, positive_id long, positive_score long, score long, id long",
    )
    ranked = _first(second, ["anchor_id", "key", "slot"], settings.negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
