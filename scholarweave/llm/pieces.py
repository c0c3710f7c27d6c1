"""SentencePiece encoding by a table of distinct marked words, and decoding.

Where no piece of the vocabulary goes on past a white space marker, a text can be cut before its markers without changing its pieces: each marked word
(markers and what follows them) is segmented by itself. All distinct marked words of the corpus are counted; tasks add up
before the shuffle. Those that occur most often, at most ``Settings.shipped`` of at most ``Settings.long`` bytes, are segmented once by the
sentencepiece library and go to all tasks as a table; nine tenths of a text are in it. The others are segmented once by each task that meets them, which
remembers them while there is room. The ids of the words are put together by their places. Texts never move, so
no key can be hot, and the only shuffle is that of the counts. (Joining the rare words back by place was tried: texts and places had to
be shuffled, which took over 4.4 times the input on disk, where 1.5 is allowed.)

Encoding is without begin and end ids and without sampling; decoding is the library's own, on whole lists of ids.

Defined results: a null or empty text has no ids and decodes to the empty text. Rows that repeat are encoded each; columns of any name may be
kept; an empty table gives an empty result. A model whose pieces cross white space markers or whose normalisation changes texts is refused with ``ValueError``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns, durable

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
_PROBES = ["a", " ", "a ", " a  b", "  two  words \n\n third\tline ", "a▁b ▁▁ c", "\x00é中文 1234,5.6 don't (x) ##", "x" * 300, " " * 50, "\n1a2b\n"]


@dataclass(frozen=True)
class Settings:
    """``shipped`` words of at most ``long`` bytes go to every task; ``held`` bounds the distinct words that a task holds at once, ``part`` the characters it cuts at once."""

    shipped: int = 200_000
    long: int = 64
    held: int = 200_000
    part: int = 1 << 20


class Model:
    """A sentencepiece model whose texts may be cut before their markers."""

    def __init__(self, content: bytes):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(len(sp))):
            raise ValueError("a piece goes on past a white space marker")
        self.mark = [sp.piece_to_id(MARK)]
        for text in _PROBES:
            if list(chain.from_iterable(self.segment(words(text)))) != sp.encode(text):
                raise ValueError("the model changes texts before it cuts them into pieces")

    def segment(self, marked: list[str]) -> list[list[int]]:
        """The ids of marked words; the library adds the marker that ``words`` has taken off."""
        return [ids if w else self.mark for w, ids in zip(marked, self.processor.encode(marked, num_threads=1), strict=True)]


def words(text: str | None) -> list[str]:
    """The marked words of a text, each without the first of its markers."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [w[1:] for w in _MARKED.findall(MARK + text.replace(" ", MARK))]


@lru_cache(maxsize=2)
def model_of(content: bytes) -> Model:
    return Model(content)


def read_model(path: str) -> bytes:
    """The model file; its content goes to the tasks, so executors need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


def count_words(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > settings.held:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The words of ``counted`` that are shipped: all short ones from the smallest count on at which they are not too many."""
    short = counted.filter(F.octet_length("word") <= settings.long)
    # counts up to 64 by themselves, larger ones in steps of about a tenth: some hundred rows
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 64)
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, total = np.iinfo(np.int64).max, 0
    for r in steps:
        total += r["c"]
        if total > settings.shipped:
            break
        least = r["least"]
    return short.filter(F.col("n") >= int(least))


# Words whose ids are Python numbers at a time.
PACKED = 8192


def packed(lists: Iterable[list[int]]) -> Iterator[bytes]:
    """Each list of ids as four bytes an id: a word's ids take a quarter of what Python numbers would."""
    return (np.array(ids, dtype=np.int32).tobytes() for ids in lists)


def segment_words(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` (word, n) with ``ids``."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"ids": pa.array(model_of(model).segment(batch.column(batch.schema.get_field_index("word")).to_pylist()), pa.list_(pa.int32()))}

    return add_columns(rows, work, "ids array<int>", ["word", "n"], ["word"])


def encode(docs: DataFrame, model: bytes, keep: list[str], settings: Settings = Settings()) -> DataFrame:
    """``keep`` columns of ``docs`` (with ``text``) and ``ids``."""
    counted = durable(count_words(docs, settings))
    rows = segment_words(frequent(counted, settings), model).toArrow()  # at most ``shipped`` short rows
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(rows["word"].to_pylist(), packed(rows["ids"].to_pylist()), strict=True)))
    memory: dict[str, bytes] = {}  # of one task

    def ids_of(cut: list[list[str]]) -> Iterator[np.ndarray]:
        known = table.value
        rare = set().union(*cut) - known.keys()
        if len(memory) + len(rare) > settings.held:
            memory.clear()
        new = list(rare - memory.keys())
        for at in range(0, len(new), PACKED):
            some = new[at : at + PACKED]
            memory.update(zip(some, packed(model_of(model).segment(some)), strict=True))
        for marked in cut:
            yield np.frombuffer(b"".join([known.get(w) or memory[w] for w in marked]), dtype=np.int32)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = _parts(batch.column(batch.schema.get_field_index("text")), settings.part)
        return {"ids": pa.array([ids for part in texts for ids in ids_of([words(t) for t in part])], pa.list_(pa.int32()))}

    return add_columns(docs, work, "ids array<int>", [c for c in keep if c != "ids"], ["text"], 4 * settings.part)


def _parts(column: pa.Array, limit: int) -> Iterator[list[str]]:
    """The texts of a column in parts of at most ``limit`` characters or one text; null is empty."""
    size, texts = 0, []
    for value in column:
        text = value.as_py() or ""
        if texts and size + len(text) > limit:
            yield texts
            size, texts = 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


def decode(encoded: DataFrame, model: bytes, keep: list[str], settings: Settings = Settings()) -> DataFrame:
    """``keep`` columns and ``decoded``: the library's text for ``ids``; null ids decode to the empty text."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column, own, out = batch.column(batch.schema.get_field_index("ids")), model_of(model).processor, []
        lengths = np.diff(column.offsets.to_numpy()) * np.asarray(column.is_valid())
        ids, ends = column.flatten().to_numpy(), np.cumsum(lengths)
        at = 0
        while at < len(ends):  # parts of lists, so that few ids are Python numbers at a time
            begin = ends[at] - lengths[at]
            stop = max(at + 1, int(np.searchsorted(ends, begin + settings.part // 4, side="right")))
            out += own.decode([ids[e - n : e].tolist() for n, e in zip(lengths[at:stop], ends[at:stop], strict=True)])
            at = stop
        return {"decoded": pa.array(out, pa.string())}

    return add_columns(encoded, work, "decoded string", keep, ["ids"], 4 * settings.part)
