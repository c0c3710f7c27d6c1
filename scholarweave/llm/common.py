"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.session import BROADCAST_BYTES, durable

__all__ = ["BROADCAST_BYTES", "add_columns", "durable", "join_lists", "join_sized", "masked", "remainder", "restored", "table"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, of: int) -> Column:
    """crc32 of the value as text, modulo ``of``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def masked(df: DataFrame, *known: str) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with every column but the ``known`` ones renamed, so that no name clashes with those of an operator; and each old name's column."""
    names = [c if c in known else f"k{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), {c: F.col(n) for c, n in zip(df.columns, names, strict=True)}


def restored(df: DataFrame, back: dict[str, Column]) -> DataFrame:
    """The columns that ``masked`` renamed, under their old names."""
    return df.select(*[c.alias(name) for name, c in back.items()])


def add_columns(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, keep: list[str], need: list[str], most: int | None = None) -> DataFrame:
    """``keep`` columns of ``df`` and the columns that ``work`` makes from each Arrow batch of ``need``; one row stays one row.

    A made column takes the place of a kept one of the same name. With ``most``, batches are worked on in slices of about that many bytes, one row at least.
    """
    made_fields = re.split(r",(?![^<]*>)\s*", schema)
    made_names = [field.split()[0].strip("`") for field in made_fields]
    keep = [c for c in keep if c not in made_names]
    columns = list(dict.fromkeys(keep + need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in (slices(b, most) if most else [b])):
            batch = batch.rename_columns(columns)
            found = work(batch)
            made = [found[name] for name in made_names]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + made, names=[f"_{i}" for i in range(len(keep) + len(made))])

    # columns go through the task under plain names, since theirs may hold dots or backticks
    chosen = df.select(*[F.col(_quoted(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    fields = [(f"_{i}", f.dataType.simpleString()) for i, f in enumerate(chosen.schema.fields[: len(keep)])]
    fields += [(f"_{len(keep) + i}", field.split(None, 1)[1]) for i, field in enumerate(made_fields)]
    made = chosen.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields))
    return made.toDF(*keep, *made_names)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, halved until a slice has at most ``most`` bytes or one row; an empty batch is one slice."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_sized(large: DataFrame, small: DataFrame, on: str, how: str, row_bytes: int) -> DataFrame:
    """Join with a ``small`` that is already stored: shipped whole if its counted size is under the bound, else both sides are shuffled.

    ``row_bytes`` is an upper estimate of one row. The answer is the same either way.
    """
    if small.count() * row_bytes <= BROADCAST_BYTES // 2:
        small = F.broadcast(small)
    return large.join(small, on, how)


def join_lists(large: DataFrame, small: DataFrame, on: str, values: str, value_bytes: int) -> DataFrame:
    """Inner join with a stored ``small`` that has an array ``values`` for each row, shipped whole if its counted bytes are under the bound.

    ``value_bytes`` is the size of one value in Spark's rows: 8 for a number, 32 for a pair.

    If they are not, its ids are shipped where those are, so that only rows of ``large`` with a partner are shuffled;
    beyond that both sides are shuffled as they are. The answer is the same each way.
    """
    n, total = small.agg(F.count("*"), F.coalesce(F.sum(F.size(values)), F.lit(0))).first()
    if 64 * n + value_bytes * total <= BROADCAST_BYTES // 2:
        return large.join(F.broadcast(small), on)
    if 64 * n <= BROADCAST_BYTES // 2:
        large = large.join(F.broadcast(small.select(on)), on, "left_semi")
    return large.join(small, on)
