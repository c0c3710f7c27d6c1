"""Vector store operators: exact filtered top-k, neighbours of every vector, mean vectors.

Vectors live in ``array<float>`` columns of a table with node_id, node_type, embedding.
Similarity arithmetic runs in numpy on Arrow batches inside the tasks. The smaller
side is shipped to the tasks only while it stays under ``BROADCAST_BYTES``; beyond
that it is cut into cells, a task each, which hold their vectors and lists
while the other side streams by.

Equal similarities are ordered by node id; similarities count as equal when they agree
to nine decimals, which makes the order independent of summation order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarweave.operators.ranking import top_per_group
from scholarweave.session import BROADCAST_BYTES

DIGITS = 9
# Scores that are compared at once, list entries and bytes of vectors that a task holds.
STEP = 1 << 20
LISTED = 1 << 23
CELL_BYTES = 1 << 25


# --- plain column arithmetic -------------------------------------------------------


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def normalize(vector: Column) -> Column:
    """Unit vector; one already of length 1 (to 1e-6) is kept, a zero vector becomes null."""
    length = norm(vector)
    scaled = F.transform(vector, lambda x: (x / length).cast("float"))
    return F.when(F.abs(length - 1.0) <= 1e-6, vector).when(length > 0, scaled)


def l2_similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def matches(filters: dict | None) -> Column:
    """Metadata predicate: a list means any of, a scalar means equal, a missing value never matches."""
    test = F.lit(True)
    for name, wanted in (filters or {}).items():
        column = F.col(name)
        one = column.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else column == wanted
        test = test & F.coalesce(one, F.lit(False))
    return test


def restrict(store: DataFrame, node_types: Sequence[str] | None = None, filters: dict | None = None) -> DataFrame:
    if node_types is not None:
        store = store.filter(F.col("node_type").isin(list(node_types)))
    return store.filter(matches(filters)) if filters else store


def mean_vector(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean embedding per key (or over all rows): averaged per position, then put in order."""
    parts = vectors.select(*keys, F.posexplode("embedding").alias("_pos", "_x"))
    means = parts.groupBy(*keys, "_pos").agg(F.avg("_x").cast("float").alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_m")))  # one entry per dimension
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_m"]).alias("embedding"))


def pairwise_moments(store: DataFrame) -> DataFrame:
    """Mean and population deviation of the cosine over all ordered pairs, without forming a pair.

    With unit rows u, the sum over all pairs is |sum u|^2 and the sum of squares is the
    squared norm of the d x d moment matrix; the n pairs of a vector with itself are
    taken out. Both come from one aggregation over (position, position).
    """
    unit = store.select(normalize(F.col("embedding")).alias("u")).filter(F.col("u").isNotNull())
    rows = unit.select(F.transform("u", lambda x: x.cast("double")).alias("u"))
    n = rows.select(F.count("*").cast("double")).scalar()
    first = rows.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    total = first.select(F.sum(F.col("s") * F.col("s"))).scalar()
    partial = rows.mapInArrow(_moment, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m"))
    squares = partial.agg(F.sum(F.col("m") * F.col("m")).alias("q"))
    pairs = n * (n - 1)
    mean = (total - n) / pairs
    return squares.select(
        pairs.cast("long").alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest((F.col("q") - n) / pairs - mean * mean, F.lit(0.0))).alias("std")
    )


def _moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column(0))
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "m"]
        )


def store_info(store: DataFrame) -> DataFrame:
    """One row: vectors, dimension, node types, and the size of the raw vectors in MB."""
    return store.agg(
        F.count("*").alias("total_vectors"),
        F.max(F.size("embedding")).alias("dimension"),
        F.count_distinct("node_type").alias("node_types"),
        (F.sum(F.size("embedding")) * 4 / 1048576).alias("size_mb"),
    )


# --- numpy helpers used inside tasks -------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as a sortable array (numbers, or text in code point order)."""
    return np.array(column.to_pylist())


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        squared = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2.0 * queries @ rows.T
        return 1.0 / (1.0 + np.sqrt(np.maximum(squared, 0.0)))
    if metric == "ip":
        return queries @ rows.T
    return _unit(queries) @ _unit(rows).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best columns by (score to nine decimals, id); -inf marks columns to leave out."""
    rounded = np.round(scores, DIGITS)
    n = scores.shape[1]
    if k < n:  # anything tied with the k-th best stays in
        kth = np.partition(rounded, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(rounded >= kth[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(rounded, dtype=bool))
    keep = np.isfinite(rounded[rows, cols])
    rows, cols = rows[keep], cols[keep]
    order = np.lexsort((ids[cols], -rounded[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, rows, side="left")
    first = np.arange(len(rows)) - starts < k
    return rows[first], cols[first]


class _Lists:
    """The ``k`` best of the rows seen so far for each of ``n`` vectors; rows come in ascending order of their ids, so of equal scores the first seen stays."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, -np.inf)  # rounded score of the last of each full list
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.room = 0, n * k

    def add(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> None:
        """Scores of all vectors with some rows; rows of the id in ``own`` are a vector's own."""
        if self.k < scores.shape[1] and not np.isfinite(self.floor).all():
            if own is not None:
                scores[own[:, None] == ids[None, :]] = -np.inf
            rows, cols = _best(scores, ids, self.k)
        else:  # the margin only saves rounding what cannot round to more than the floor
            rows, cols = np.nonzero(scores > (self.floor + 0.4 * 10.0**-DIGITS)[:, None])
        values = scores[rows, cols]
        keep = np.isfinite(values) & (np.round(values, DIGITS) > self.floor[rows])
        if own is not None:
            keep &= own[rows] != ids[cols]
        self.parts.append((rows[keep].astype(np.int32), values[keep], ids[cols[keep]]))
        self.waiting += len(self.parts[-1][0])
        if self.waiting >= self.room:
            self._settle()

    def _settle(self) -> None:
        rows, values, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        rounded = np.round(values, DIGITS)
        # stable sorts: equal ones stay in the order of their ids
        if len(rounded) and np.abs(rounded).max() <= 2:  # cosines: vector and score make one number
            order = np.argsort((rows.astype(np.int64) << 33) - np.rint(rounded * 10**DIGITS).astype(np.int64), kind="stable")
        else:
            order = np.lexsort((-rounded, rows))
        rank = _places(rows[order])
        last = order[rank == self.k - 1]
        self.floor[rows[last]] = rounded[last]
        order = order[rank < self.k]
        self.parts, self.waiting = [(rows[order], values[order], ids[order])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vector, score, id, rank), lists one after the other."""
        if not self.parts:
            return np.array([], int), np.array([]), np.array([], int), np.array([], int)
        self._settle()
        rows, values, ids = self.parts[0]
        return rows, values, ids, _places(rows) + 1


def _places(rows: np.ndarray) -> np.ndarray:
    """Place of each entry among the equal ones of a sorted array, from 0."""
    sizes = np.bincount(rows)
    return np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Scan:
    """Lists of many vectors, kept and compared ``STEP`` scores at a time."""

    def __init__(self, keys: np.ndarray, matrix: np.ndarray, k: int, metric: str, drop_self: bool):
        self.keys, self.k, self.metric, self.drop_self = keys, k, metric, drop_self
        self.matrix = _unit(matrix) if metric == "cosine" else matrix
        self.size = max(1, min(512, LISTED // 4 // max(k, 1)))
        self.lists = [_Lists(len(self.matrix[at : at + self.size]), k) for at in range(0, len(matrix), self.size)]

    def see(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not self.k:
            return
        rows = _unit(rows) if self.metric == "cosine" else rows
        step = STEP // self.size
        for start in range(0, len(rows), step):
            some, names = rows[start : start + step], ids[start : start + step]
            for i, kept in enumerate(self.lists):
                at = i * self.size
                left = self.matrix[at : at + self.size]
                scores = left @ some.T if self.metric == "cosine" else _scores(left, some, self.metric)
                kept.add(scores, names, self.keys[at : at + self.size] if self.drop_self else None)

    def batches(self, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of key, id, score and, if the schema has a fourth field, rank; the lists are given up on the way."""
        for i in range(len(self.lists)):
            kept, self.lists[i] = self.lists[i], None
            rows, values, ids, rank = kept.result()
            for at in range(0, len(rows), 1 << 18):
                part = slice(at, at + (1 << 18))
                columns = [self.keys[i * self.size + rows[part]].tolist(), ids[part].tolist(), values[part], rank[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=False)], schema=arrow)


def best_in_cells(left: DataFrame, right: DataFrame, cells: int, k: int, metric: str = "cosine", drop_self: bool = False) -> DataFrame:
    """(query_id, node_id, similarity, rank): of the ``right`` rows (cell, node_id, embedding), the k best for each ``left`` row (cell, query_id, embedding) of their cell.

    A cell is one task. It holds its left rows and their lists, and the right rows, sorted by id, stream by: a cell may have any number of them.
    """
    key, node = left.schema["query_id"].dataType, right.schema["node_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", key), T.StructField("node_id", node), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    ])
    arrow = _arrow(schema)
    left = left.select("cell", F.lit(0).alias("_side"), "query_id", F.lit(None).cast(node).alias("node_id"), "embedding")
    right = right.select("cell", F.lit(1).alias("_side"), F.lit(None).cast(key).alias("query_id"), "node_id", "embedding")
    dealt = left.unionByName(right).repartitionById(cells, F.col("cell")).sortWithinPartitions("_side", "node_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, scan = [], [], None
        for batch in batches:
            n = batch.num_rows - int(np.count_nonzero(batch.column(0).to_numpy()))
            if n:
                keys.append(_ids(batch.column(1).slice(0, n)))
                rows.append(_matrix(batch.column(3).slice(0, n)))
            if n < batch.num_rows and keys:
                if scan is None:
                    scan = _Scan(np.concatenate(keys), np.concatenate(rows), k, metric, drop_self)
                scan.see(_ids(batch.column(2).slice(n)), _matrix(batch.column(3).slice(n)))
        if scan is not None:
            yield from scan.batches(arrow)

    return dealt.select("_side", "query_id", "node_id", "embedding").mapInArrow(run, schema)


def cell_rows(k: int, dimension: int, largest: int = 1 << 16) -> int:
    """Left rows of one cell: as many as keep lists and vectors of a task bounded."""
    return max(1, min(largest, LISTED // max(k, 1), CELL_BYTES // (8 * max(dimension, 1))))


def _against_all(left: DataFrame, right: DataFrame, n: int, size: int, k: int, metric: str = "cosine", drop_self: bool = False) -> DataFrame:
    """``best_in_cells`` of ``n`` left rows, ``size`` to a cell, with all right rows in each cell."""
    cells = max(-(-n // size), left.sparkSession.sparkContext.defaultParallelism)
    dealt = left.withColumn("cell", F.pmod(F.xxhash64("query_id"), F.lit(cells)).cast("int"))
    everywhere = right.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "node_id", "embedding")
    return best_in_cells(dealt, everywhere, cells, k, metric, drop_self)


# --- search ----------------------------------------------------------------------------


def search(
    store: DataFrame,
    queries: DataFrame,
    k: int,
    node_types: Sequence[str] | None = None,
    filters: dict | None = None,
    min_similarity: float | None = None,
    metric: str = "cosine",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query_id, node_id, similarity, rank): the k most similar stored vectors of each query.

    ``queries`` has query_id and embedding. Filters come before the ranking, so a query
    gets k rows whenever that many match. A zero query finds nothing.
    """
    store = restrict(store, node_types, filters).select("node_id", "embedding")
    asked = queries.select("query_id", "embedding")
    id_type, key_type = store.schema["node_id"].dataType, asked.schema["query_id"].dataType
    schema = T.StructType(
        [T.StructField("query_id", key_type), T.StructField("node_id", id_type), T.StructField("similarity", T.DoubleType())]
    )
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] == 0:
        return store.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if size["n"] * (8 * size["d"] + 64) <= limit_bytes and size["n"] * k <= LISTED:
        local = asked.toArrow()
        keys, matrix = _ids(local.column("query_id")), _matrix(local.column("embedding"))
        found = store.sortWithinPartitions("node_id").mapInArrow(_scan(keys, matrix, k, metric, _arrow(schema)), schema)
    else:
        live = asked.filter(norm(F.col("embedding")) > 0)
        found = _against_all(live, store, size["n"], cell_rows(k, size["d"]), k, metric).drop("rank")
    if min_similarity is not None:
        found = found.filter(F.col("similarity") >= min_similarity)
    return top_per_group(found, ["query_id"], [F.desc(F.round("similarity", DIGITS)), F.asc("node_id")], k)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _scan(keys: np.ndarray, matrix: np.ndarray, k: int, metric: str, arrow: pa.Schema):
    live = np.flatnonzero(np.linalg.norm(matrix, axis=1) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(keys[live], matrix[live], k, metric, drop_self=False)
        for batch in batches:
            if batch.num_rows:
                scan.see(_ids(batch.column(0)), _matrix(batch.column(1)))
        yield from scan.batches(arrow)

    return run


# --- neighbours of every vector ------------------------------------------------------------


def neighbours(store: DataFrame, k: int, positive_only: bool = True, limit_bytes: int = BROADCAST_BYTES, cell: int = 1 << 16) -> DataFrame:
    """(src, dst, similarity, rank): each vector's k most similar other vectors by cosine."""
    store = store.select("node_id", "embedding")
    size = store.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] < 2:
        k = 0
    if size["n"] * (8 * (size["d"] or 0) + 64) <= limit_bytes:
        found = _neighbours_whole(store, k)
    else:
        asked = store.withColumnRenamed("node_id", "query_id")
        found = _against_all(asked, store, size["n"], cell_rows(k, size["d"], cell), k, drop_self=True)
        found = found.withColumnsRenamed({"query_id": "src", "node_id": "dst"})
    if positive_only:
        found = found.filter(F.col("similarity") > 0)
    return found


def linked(store: DataFrame, least: float, cell: int = 1 << 16) -> DataFrame:
    """(src, dst): links that join the vectors which pairs with a cosine of ``least`` or more join, directly or through others.

    Every vector meets every other, in cells that hold up to ``cell`` of them. A task gives a spanning forest of its pairs: a row for each vector at most, however many
    pairs there are. Vectors without a direction (null, zero) have no links.
    """
    live = store.select("node_id", "embedding").filter(norm(F.col("embedding")) > 0)
    kind = live.schema["node_id"].dataType
    size = live.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    cells = max(-(-size["n"] // cell_rows(1, size["d"] or 0, cell)), live.sparkSession.sparkContext.defaultParallelism)
    held = live.select(F.pmod(F.xxhash64("node_id"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("_side"), "node_id", "embedding")
    passing = live.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("_side"), "node_id", "embedding")
    dealt = held.unionByName(passing).repartitionById(cells, F.col("cell")).sortWithinPartitions("_side")
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, forest = [], [], None
        for batch in batches:
            n = batch.num_rows - int(np.count_nonzero(batch.column(0).to_numpy()))
            if n:
                keys.append(_ids(batch.column(1).slice(0, n)))
                rows.append(_matrix(batch.column(2).slice(0, n)))
            if n < batch.num_rows and keys:
                forest = forest or _Forest(np.concatenate(keys), np.concatenate(rows), least)
                for links in forest.see(_ids(batch.column(1).slice(n)), _matrix(batch.column(2).slice(n))):
                    yield _link_rows(*links, arrow)
        if forest:
            yield _link_rows(*forest.links(), arrow)

    return dealt.select("_side", "node_id", "embedding").mapInArrow(run, schema)


def _link_rows(src: np.ndarray, dst: np.ndarray, arrow: pa.Schema) -> pa.RecordBatch:
    some = src != dst
    return pa.RecordBatch.from_arrays([pa.array(x[some].tolist(), f.type) for x, f in zip((src, dst), arrow, strict=True)], schema=arrow)


class _Forest:
    """Vectors of a cell and what joins them: ``label`` is the first of those that are known to belong together."""

    def __init__(self, keys: np.ndarray, matrix: np.ndarray, least: float):
        self.keys, self.matrix, self.least = keys, _unit(matrix), least
        self.label = np.arange(len(keys))

    def see(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Joins the held vectors that a row is similar to; gives the rows with one of these each."""
        rows = _unit(rows)
        for start in range(0, len(rows), STEP >> 9):
            some, names = rows[start : start + (STEP >> 9)], ids[start : start + (STEP >> 9)]
            first = np.full(len(some), -1)
            for at in range(0, len(self.matrix), 512):
                scores = some @ self.matrix[at : at + 512].T
                row, held = np.nonzero(scores >= self.least - 10.0**-DIGITS)
                near = np.round(scores[row, held], DIGITS) >= self.least
                row, held = row[near], held[near] + at
                unmet = first[row] < 0
                first[row[unmet]] = held[unmet]
                self._join(held, first[row])
            met = first >= 0
            yield names[met], self.keys[first[met]]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        up = None
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            up = np.arange(len(self.label)) if up is None else up
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up != up[up]).any():
                up = up[up]
            a, b = up[a], up[b]
        if up is not None:
            self.label = up[self.label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, self.keys[self.label]


def neighbours_percent(store: DataFrame, percent: float = 20.0) -> DataFrame:
    """List length as a share of all vectors, at least one."""
    return neighbours(store, max(1, int(store.count() * percent / 100)))


def _neighbours_whole(store: DataFrame, k: int) -> DataFrame:
    """The matrix fits every task: each batch of vectors is finished where it is, no shuffle."""
    id_type = store.schema["node_id"].dataType
    schema = T.StructType(
        [
            T.StructField("src", id_type), T.StructField("dst", id_type),
            T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType()),
        ]
    )
    arrow = _arrow(schema)
    local = store.orderBy("node_id").toArrow()
    all_ids, matrix = _ids(local.column("node_id")), _matrix(local.column("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, min(1024, LISTED // max(k, 1)))
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                scan = _Scan(_ids(part.column(0)), _matrix(part.column(1)), k, "cosine", drop_self=True)
                scan.see(all_ids, matrix)
                yield from scan.batches(arrow)

    spread = max(1, store.sparkSession.sparkContext.defaultParallelism)
    return store.repartition(spread, "node_id").mapInArrow(run, schema)
