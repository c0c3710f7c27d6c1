"""Quality classifier: an additive model of one- and two-feature lookup tables.

Each table is the sum of many small trees, grown in turn over the features (cyclic
boosting on logistic loss, every tree sees one feature or one pair of features).
Boosting needs only histograms of gradients over bins. Scoring a document is one
lookup per feature and pair and a sum, done for whole Arrow batches.

The model is fitted on the driver on at most ``Settings.sample`` labelled rows, taken
in the order of a hash of the id, so the fit is bounded at any corpus size; every
document is scored. Inputs of a score are counts over the whole text and nothing else.

Defined results: a null or empty text has all features 0 and gets a score like any
other. Labels that are null are no labels; a document labelled more than once has the
mean of its labels, 1 from one half up. Without labels the score is 0.5, with one class
it is that class's smoothed share. Rows repeated in the input are scored each. An empty
table gives an empty result. Further input columns are kept; ``score`` is the caller's name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns
from scholarweave.llm.words import BLANKS, Words, byte_table, per_row, slices

FEATURES = (
    "log_words", "word_bytes", "symbols", "exclamations", "capitals", "digits", "bars", "stops", "lines", "not_ascii", "distinct_words",
    "repeated_threes", "repeated_lines", "capital_words", "ends_in_symbol", "longest_word",
)

_SYMBOLS = byte_table(b"#*$%&|<>{}[]\\/_=+~^@")
_CAPITALS = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = byte_table(b"0123456789")
_STOPS = byte_table(b".,;:?")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows used for fitting."""

    sample: int = 20_000
    bins: int = 32
    rounds: int = 150
    pair_bins: int = 12
    pairs: int = 8
    pair_rounds: int = 60
    rate: float = 0.15
    smoothing: float = 5.0


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        coarse = [np.searchsorted(edges, x[:, j], side="right") for j, edges in enumerate(self.pair_edges)]
        for i, j, values in self.pairs:
            total += values[coarse[i], coarse[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True at each key that occurs at a smaller place too."""
    out = np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys, kind="stable")
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for a, b, buf, bounds in slices(column):
        words, n_bytes = Words(buf, bounds), np.maximum(1, np.diff(bounds))
        sizes, n, row = words.end - words.start, words.counts(), words.row_of()
        some = np.maximum(1, n)
        salt = row.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)  # the same word in two rows is two keys
        at, threes = words.window_codes(3)
        again = np.zeros(len(words), dtype=bool)
        again[at] = _repeats(threes ^ salt[at])
        cut = buf == 10
        ends = np.zeros(len(buf) + 1, dtype=bool)
        ends[bounds[1:]] = True
        parts = Words(buf, bounds, byte_table(b"\n"))
        line_row = parts.row_of()
        same = _repeats(parts.code ^ (line_row.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))

        def share(table: np.ndarray, buf=buf, bounds=bounds, n_bytes=n_bytes) -> np.ndarray:
            return per_row(table[buf], bounds) / n_bytes

        last = buf[words.end - 1] if len(words) else buf[:0]
        begin = buf[words.start] if len(words) else buf[:0]
        longest = np.zeros(b - a)
        full = np.flatnonzero(n)
        if len(full):
            longest[full] = np.maximum.reduceat(sizes, words.first[:-1][full])
        out[a:b] = np.stack([
            np.log1p(n), per_row(sizes, words.first) / some, share(_SYMBOLS), share(byte_table(b"!")), share(_CAPITALS), share(_DIGITS),
            per_row((sizes == 1) & (begin == ord("|")), words.first) / some, share(_STOPS), per_row(cut, bounds) / some, per_row(buf > 127, bounds) / n_bytes,
            1 - per_row(_repeats(words.code ^ salt), words.first) / some, per_row(again, words.first) / some, per_row(same, parts.first) / np.maximum(1, parts.counts()),
            per_row(_CAPITALS[begin], words.first) / some, per_row(_SYMBOLS[last] & (sizes > 1), words.first) / some, np.log1p(longest),
        ], axis=1)
    return out


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray, smoothing: float) -> np.ndarray:
    return g * g / (h + smoothing)


def _best_cut(g: np.ndarray, h: np.ndarray, smoothing: float) -> tuple[float, int]:
    """Gain of the best split of a histogram and the number of bins on its left."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl, smoothing) + _gain(g.sum() - gl, h.sum() - hl, smoothing) - _gain(g.sum(), h.sum(), smoothing)
    k = int(np.argmax(gains))
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, smoothing: float, depth: int = 2) -> np.ndarray:
    """Values of a tree of ``depth`` levels for each bin."""
    gain, cut = _best_cut(g, h, smoothing) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + smoothing))
    return np.concatenate([_tree(g[:cut], h[:cut], smoothing, depth - 1), _tree(g[cut:], h[cut:], smoothing, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, smoothing: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one feature, then the other on each side."""
    best, values = 0.0, np.full(g.shape, g.sum() / (h.sum() + smoothing))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            gain = 0.0
            sides = []
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                more, k = _best_cut(pg, ph, smoothing)
                gain += more + _gain(pg.sum(), ph.sum(), smoothing)
                sides.append((part, k, pg, ph))
            gain -= _gain(g.sum(), h.sum(), smoothing)
            if gain > best + 1e-12:
                best, made = gain, np.zeros(a.shape)
                for part, k, pg, ph in sides:
                    made[part, :k] = pg[:k].sum() / (ph[:k].sum() + smoothing)
                    made[part, k:] = pg[k:].sum() / (ph[k:].sum() + smoothing)
                values = made.T if flip else made
    return best, values


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Cyclic boosting: all features in turn, then the pairs with most left to explain."""
    if len(y) == 0:
        return Model()
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(intercept=math.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    s, n = settings.smoothing, x.shape[1]
    model.edges = [_edges(x[:, j], settings.bins) for j in range(n)]
    model.pair_edges = [_edges(x[:, j], settings.pair_bins) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(settings.rounds):
        for j in range(n):
            g, h = slopes()
            size = len(model.tables[j])
            step = settings.rate * _tree(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size), s)
            model.tables[j] += step
            total += step[fine[j]]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        cell = coarse[i] * shape[1] + coarse[j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    left = sorted(((-_pair_tree(*grid(i, j, g, h), s)[0], i, j) for i in range(n) for j in range(i)))
    chosen = [(i, j) for gain, i, j in left[: settings.pairs] if gain < 0]
    made = {pair: np.zeros((len(model.pair_edges[pair[0]]) + 1, len(model.pair_edges[pair[1]]) + 1)) for pair in chosen}
    for _ in range(settings.pair_rounds):
        for i, j in chosen:
            step = settings.rate * _pair_tree(*grid(i, j, *slopes()), s)[1]
            made[i, j] += step
            total += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, values) for (i, j), values in made.items()]
    return model


def _as_column(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1), pa.float64())
    return pa.FixedSizeListArray.from_arrays(flat, values.shape[1]).cast(pa.list_(pa.float64()))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``settings.sample`` labelled documents; ``labels`` has (doc_id, quality)."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("mark"))
    # bounded by the limit: small enough to ship
    chosen = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample))
    known = docs.select("doc_id", "text").join(chosen, "doc_id")
    found = add_columns(known, lambda batch: {"x": _as_column(features(batch.column(batch.schema.get_field_index("text"))))}, "x array<double>", ["doc_id", "mark"], ["text"]).toArrow()
    if not len(found):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(len(found), len(FEATURES))
    ids = found.column("doc_id").to_numpy()
    order = np.lexsort((*x.T, ids))  # the order of arrival does not matter
    return x[order], found.column("mark").to_numpy()[order].astype(float)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (default: all) of each document and its ``score``."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {name: pa.array(model.score(features(batch.column(batch.schema.get_field_index("text")))))}

    return add_columns(docs, work, f"`{name}` double", docs.columns if keep is None else keep, ["text"])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return fit(*training_rows(docs, labels, settings), settings)
