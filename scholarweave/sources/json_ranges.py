"""The objects of one large JSON file, read by many tasks: byte ranges of {"nodes": [{...}, ...], "edges": [{...}, ...]}.

What a byte means depends on whether it stands in a string and how deep it is nested, which a range cannot see. So every
range is first scanned for both cases (its start is in a string, or it is not), and reports for each how the depth changes and for both whether
the number of quotes is odd. Folding these few numbers a range gives every range its state. Then the ranges look for the arrays of the root, and at last give
the objects that begin in them as text; an object that goes on behind the range is read to its end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

RANGE_BYTES = 8 * 1024 * 1024
LOOK_BACK = 4096
QUOTE, BACKSLASH = ord('"'), ord("\\")
RANGE = "at long, size long, in_string boolean, depth long"
# the name of an array, just before its bracket
NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


def _open(uri: str):
    """A file that any task can open: local path or the address of a shared store."""
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def _range(source, at: int, size: int) -> tuple[bytes, bool]:
    """The bytes of a range, and whether the first one is escaped by what stands before it."""
    back = 64
    while True:
        before = source.read_at(min(back, at), at - min(back, at))
        run = len(before) - len(before.rstrip(b"\\"))
        if run < len(before) or back >= at:
            return source.read_at(size, at), run % 2 == 1
        back *= 16


def structure(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, steps, before, quotes): the brackets of a range, +1 or -1 each, the unescaped quotes before each, and their number in all."""
    raw = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(raw == QUOTE)
    slashes = np.flatnonzero(raw == BACKSLASH)
    if len(slashes) or escaped:
        # the first backslash of the run that each one belongs to
        starts = slashes[np.flatnonzero(np.diff(slashes, prepend=-2) > 1)]
        ends = np.zeros(0, dtype=np.int64)
        if len(slashes):
            run_of = np.cumsum(np.diff(slashes, prepend=-2) > 1) - 1
            lengths = np.bincount(run_of)
            if escaped and starts[0] == 0:
                lengths[0] += 1
            ends = (starts + np.bincount(run_of))[lengths % 2 == 1]
        if escaped and not (len(starts) and starts[0] == 0):
            ends = np.append(ends, 0)
        quotes = quotes[~np.isin(quotes, ends)]
    opens, closes = (raw == ord("{")) | (raw == ord("[")), (raw == ord("}")) | (raw == ord("]"))
    places = np.flatnonzero(opens | closes)
    return places, np.where(opens[places], 1, -1), np.searchsorted(quotes, places), len(quotes)


def _summary(source, row) -> Iterator[tuple]:
    places, steps, before, quotes = structure(*_range(source, row.at, row.size))
    outside = before % 2 == 0
    yield int(row.at), bool(quotes % 2), int(steps[outside].sum()), int(steps[~outside].sum())


def _outer(source, row) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The brackets outside strings, with the depth before each."""
    data, escaped = _range(source, row.at, row.size)
    places, steps, before, _ = structure(data, escaped)
    outside = (before + row.in_string) % 2 == 0
    places, steps = places[outside], steps[outside]
    return data, places, steps, row.depth + np.cumsum(steps) - steps


def _arrays(source, row) -> Iterator[tuple]:
    data, places, steps, depth = _outer(source, row)
    for place in places[(depth == 1) & (steps == 1)].tolist():
        if data[place : place + 1] == b"[":
            at = row.at + place
            back = min(LOOK_BACK, at)
            name = NAME.search(source.read_at(back, at - back))
            yield int(at), name.group(1).decode() if name else ""


def _objects(source, row, arrays: list[tuple[int, str]]) -> Iterator[tuple]:
    data, places, steps, depth = _outer(source, row)
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = places[(depth == 2) & (steps == 1) & (raw[places] == ord("{"))]
    ends = places[(depth == 3) & (steps == -1) & (raw[places] == ord("}"))]
    wheres = np.searchsorted([at for at, _ in arrays], row.at + starts) - 1
    closing = np.searchsorted(ends, starts)
    for start, where, which in zip(starts.tolist(), wheres.tolist(), closing.tolist()):
        text = data[start : ends[which] + 1] if which < len(ends) else _to_end(source, row.at + start)
        # a line break outside strings is space, and inside them there is none
        yield arrays[where][1], text.decode().replace("\r", " ").replace("\n", " ")


def _to_end(source, at: int) -> bytes:
    """An object that ends behind its range, read in pieces that double."""
    size = 1 << 16
    while True:
        data = source.read_at(size, at)
        places, steps, before, _ = structure(data, False)
        outside = before % 2 == 0
        closed = np.flatnonzero(np.cumsum(steps[outside]) == 0)
        if len(closed):
            return data[: places[outside][closed[0]] + 1]
        if len(data) < size:
            raise ValueError(f"an object that begins at byte {at} does not end")
        size *= 4


def _scan(ranges: DataFrame, uri: str, one: Callable, schema: str, rows_each: int = 20000) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            with _open(uri) as source:
                for row in part.itertuples():
                    held = []
                    for found in one(source, row):
                        held.append(found)
                        if len(held) == rows_each:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=names)

    return ranges.mapInPandas(run, schema)


def read_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, list[str]]:
    """(key, json): the objects in the arrays of the root object, as text of one line, and the names of the arrays there are.

    Elements that are not objects are left out. Tasks hold one range and what its last object needs beyond it.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(target)
    uri = status.getPath().toString()
    if files.getScheme() == "file":
        uri = unquote(urlparse(uri).path)
    size = status.getLen()
    starts = list(range(0, size, range_bytes)) or [0]

    def ranges(states: list[tuple[bool, int]]) -> DataFrame:
        rows = [(at, min(range_bytes, size - at), inside, depth) for at, (inside, depth) in zip(starts, states)]
        return spark.createDataFrame(rows, RANGE).repartitionByRange(len(rows), "at")

    summaries = _scan(ranges([(False, 0)] * len(starts)), uri, _summary, "at long, odd boolean, outside long, inside long").collect()
    states, inside, depth = [], False, 0
    for s in sorted(summaries, key=lambda r: r["at"]):  # a row a range
        states.append((inside, depth))
        depth, inside = depth + (s["inside"] if inside else s["outside"]), inside != s["odd"]
    if inside or depth:
        raise ValueError(f"{path} is not whole JSON")
    known = ranges(states)
    arrays = sorted(map(tuple, _scan(known, uri, _arrays, "at long, key string").collect()))  # a row an array of the root
    found = _scan(known, uri, lambda source, row: _objects(source, row, arrays), "key string, json string")
    return found, [key for _, key in arrays]
