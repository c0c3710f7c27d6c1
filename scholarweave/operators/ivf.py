"""Inverted-list search: vectors are filed under their nearest centroid, a query reads only the lists nearest to it.

Centroids come from Lloyd rounds over all vectors. A round ships the centroids (``lists`` x dimension numbers, bounded by the
parameter) and brings back one partial sum per list and task, added up by Spark. The filed table is written with the
list as its partition column, so a search names the lists it needs and Spark skips the folders of all others. The queries of a list are
cut into cells, a task each, which hold their queries while the list streams by. Results are exact within the lists that are read.

Directions decide: vectors are compared by cosine, a centroid is the mean of unit vectors. Zero and null vectors are filed nowhere and a zero
query finds nothing. Equal similarities (to nine decimals) go by list number, then by node id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarweave.operators.ranking import top_per_group
from scholarweave.operators.vectors import DIGITS, _matrix, _unit, best_in_cells, cell_rows, norm


def _usable(store: DataFrame) -> DataFrame:
    return store.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(norm(F.col("embedding")) > 0)


def _nearest(rows: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest lists of every row, nearest first."""
    scores = np.round(_unit(rows) @ _unit(centroids).T, DIGITS)
    return np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)


def train(store: DataFrame, lists: int, rounds: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """Centroids of at most ``lists`` lists after at most ``rounds`` rounds, or fewer once they move by less than ``tolerance``.

    Starts from the vectors with the smallest hashes of their ids; there are fewer lists if there are fewer vectors. A list that loses all its vectors keeps its centroid.
    """
    store = _usable(store).select("node_id", "embedding")
    first = store.orderBy(F.md5(F.col("node_id").cast("string").cast("binary")), "node_id").limit(lists).toArrow()  # at most ``lists`` rows
    if not len(first):
        return np.zeros((0, 0))
    centroids = _unit(_matrix(first["embedding"]))
    for _ in range(rounds):
        sums = store.select("embedding").mapInArrow(_partial_sums(centroids), "list int, n bigint, total array<double>")
        parts = sums.select("list", "n", F.posexplode("total").alias("pos", "x")).groupBy("list", "pos").agg(F.sum("x").alias("x")).toArrow()  # lists x dimension numbers
        moved = centroids.copy()
        moved[parts["list"].to_numpy(), parts["pos"].to_numpy()] = parts["x"].to_numpy()
        moved = _unit(moved)
        change = float(np.abs(moved - centroids).max())
        centroids = moved
        if change < tolerance:
            break
    return centroids


def _partial_sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _unit(_matrix(batch.column(0)))
                own = _nearest(rows, centroids)[:, 0]
                np.add.at(totals, own, rows)
                counts += np.bincount(own, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(totals[used]), pa.list_(pa.float64()))], ["list", "n", "total"])

    return run


def assign(store: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """``store`` (id column first, then ``embedding``) with ``list``: one row for each of the ``probes`` nearest lists."""
    key = store.columns[0]
    rows = _usable(store).select(key, "embedding")
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centroids):
                near = _nearest(_matrix(batch.column(1)), centroids, probes)
                taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near.ravel(), pa.int32())], names=[*batch.schema.names, "list"])

    return rows.mapInArrow(run, schema)


def write_index(store: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Files the vectors under ``path``/vectors, one folder a list, and the centroids under ``path``/centroids."""
    spark = store.sparkSession
    filed = assign(store.select("node_id", "embedding"), centroids)
    filed.write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def read_centroids(spark, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    return _matrix(rows["centroid"]) if len(rows) else np.zeros((0, 0))


def search_index(spark, path: str, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(query_id, node_id, similarity, rank): the ``k`` best of the ``nprobe`` lists nearest to each query (query_id, embedding)."""
    centroids = read_centroids(spark, path)
    probes = assign(queries.select("query_id", "embedding"), centroids, nprobe)
    wanted = [r["list"] for r in probes.select("list").distinct().collect()]  # list numbers, at most as many as centroids
    filed = spark.read.parquet(f"{path}/vectors") if len(centroids) else None
    if not wanted or filed is None:
        return queries.sparkSession.createDataFrame([], "query_id string, node_id string, similarity double, rank int")
    return search_filed(filed.filter(F.col("list").isin(wanted)), probes, k)


def search_filed(filed: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Best rows of ``filed`` (node_id, embedding, list) for ``probes`` (query_id, embedding, list)."""
    counted = probes.groupBy("list").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).orderBy("list").collect()  # one row a list
    least, cells, total = -(-probes.sparkSession.sparkContext.defaultParallelism // max(len(counted), 1)), [], 0
    for r in counted:
        blocks = max(-(-r["n"] // cell_rows(k, r["d"])), least)
        cells.append((r["list"], total, blocks))
        total += blocks
    if not total:
        return probes.select("query_id", F.lit(None).cast(filed.schema["node_id"].dataType).alias("node_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    placed = F.broadcast(probes.sparkSession.createDataFrame(cells, "list int, first int, blocks int"))
    left = probes.join(placed, "list").select((F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("blocks"))).cast("int").alias("cell"), "query_id", "embedding")
    right = filed.join(placed, "list").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("cell"), "node_id", "embedding")
    found = best_in_cells(left, right, total, k).drop("rank")
    return top_per_group(found, ["query_id"], [F.desc(F.round("similarity", DIGITS)), F.asc("node_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact result that was found."""
    hit = exact.select("query_id", "node_id").join(found.select("query_id", "node_id", F.lit(1).alias("_hit")), ["query_id", "node_id"], "left")
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))
