"""Language of texts by unigram models that sum over all segmentations.

The pieces of a fixed public vocabulary (a file that is given, never trained here) and all
single bytes have a probability per language. A word's probability is the sum over all ways to
cut it into pieces, found by a forward pass over its bytes; a text's is the product over its words. Words are runs
of letters of the lower-cased text with one mark in front; parts of ``PART`` bytes stand for longer ones.

The probabilities are learned by expectation-maximisation (forward and backward over the
distinct words of each language), from at most ``Settings.per_language`` documents of each language, chosen
by a hash of the id: a bounded fit. Every document is scored over its whole text; equal words of a batch are passed once.

Defined results: a text that is null or has no letter is ``und`` with score 0. Documents with a null language
or id teach nothing; without any teaching document every text is ``und``. Of equal scores the
alphabetically first language wins. Repeated rows are scored each; an empty table gives an empty result.
The score is the probability of the language among those learned, all taken as equally likely before reading.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns
from scholarweave.llm.words import Words, byte_table, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PART = 32
_NO_LETTER = byte_table(bytes(range(0x61)) + bytes(range(0x7B, 0x80)))
_MARK = ord(" ")  # stands before a word


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the documents that a language is learned from."""

    per_language: int = 300
    rounds: int = 4
    smoothing: float = 0.01


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces as bytes, with a blank for the word mark, in falling order of nothing but their bytes; all single bytes are among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([i]) for i in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").lower().encode()
            if len(piece) <= PART and b" " not in piece[1:]:
                pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """All pieces that lie in some words: edges from byte to byte, in an order that a forward pass can follow."""

    def __init__(self, words: list[bytes], index: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.n = len(words)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])  # a word of n bytes has n + 1 places
        offset = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(self.n), lengths)
        inside = np.arange(len(buf)) - offset[owner]
        left = lengths[owner] - inside
        place = self.base[owner] + inside
        starts, ends, pieces, ranks = [], [], [], []
        code = np.zeros(len(buf), dtype=np.uint64)
        alive = np.arange(len(buf))
        for size in range(1, max(index) + 1):
            alive = alive[left[alive] >= size]
            if not len(alive):
                break
            # the code of the first `size` bytes from each place
            code[alive] = code[alive] * np.uint64(1099511628211) + buf[alive + size - 1].astype(np.uint64) + np.uint64(1)
            codes, ids, begun = index[size] if size in index else (None, None, None)
            if codes is not None and len(codes):
                at = np.minimum(np.searchsorted(codes, code[alive]), len(codes) - 1)
                hit = codes[at] == code[alive]
                starts.append(place[alive[hit]])
                ends.append(place[alive[hit]] + size)
                ranks.append(inside[alive[hit]] + size)
                pieces.append(ids[at[hit]])
            if begun is not None:  # places from which a longer piece can still start
                at = np.minimum(np.searchsorted(begun, code[alive]), max(len(begun) - 1, 0))
                alive = alive[begun[at] == code[alive]] if len(begun) else alive[:0]
        none = [np.zeros(0, dtype=np.int64)]
        start, end, piece, rank = (np.concatenate(x or none) for x in (starts, ends, pieces, ranks))
        order = np.lexsort((end, rank))
        self.start, self.end, self.piece, rank = start[order], end[order], piece[order], rank[order]
        self.steps = np.searchsorted(rank, np.arange(1, int(rank.max(initial=0)) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sum over segmentations up to each place; ``p`` has a row for each piece and a column for each language."""
        total = np.zeros((self.base[-1], p.shape[1]))
        total[self.base[:-1]] = 1
        for a, b in zip(self.steps[:-1], self.steps[1:], strict=True):
            if b > a:
                value = total[self.start[a:b]] * p[self.piece[a:b]]
                end = self.end[a:b]
                first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
                total[end[first]] = np.add.reduceat(value, first, axis=0)
        return total

    def backward(self, p: np.ndarray) -> np.ndarray:
        total = np.zeros((self.base[-1], p.shape[1]))
        total[self.base[1:] - 1] = 1
        for a, b in reversed(list(zip(self.steps[:-1], self.steps[1:], strict=True))):
            if b > a:
                np.add.at(total, self.start[a:b], total[self.end[a:b]] * p[self.piece[a:b]])
        return total

    def whole(self, forward: np.ndarray) -> np.ndarray:
        return forward[self.base[1:] - 1]


def piece_index(pieces: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Size -> (codes of the pieces of that size, their numbers, codes of the longer pieces' beginnings of that size)."""
    by_size: dict[int, tuple[list[int], list[int], set[int]]] = {}
    for number, piece in enumerate(pieces):
        code = 0
        for size in range(1, len(piece) + 1):
            code = (code * 1099511628211 + piece[size - 1] + 1) % (1 << 64)
            codes, ids, begun = by_size.setdefault(size, ([], [], set()))
            if size == len(piece):
                codes.append(code)
                ids.append(number)
            else:
                begun.add(code)
    out = {}
    for size, (codes, ids, begun) in by_size.items():
        order = np.argsort(np.array(codes, dtype=np.uint64))
        out[size] = np.array(codes, dtype=np.uint64)[order], np.array(ids, dtype=np.int64)[order], np.array(sorted(begun), dtype=np.uint64)
    return out


class Model:
    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self._index = self._scores = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_scores": None}

    @property
    def scores(self) -> WordScores:
        if self._scores is None:
            self._scores = WordScores(self)
        return self._scores

    @property
    def index(self):
        if self._index is None:
            self._index = piece_index(self.pieces)
        return self._index

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Logarithm of the probability of each word in each language."""
        lattice = Lattice(words, self.index)
        return np.log(np.maximum(lattice.whole(lattice.forward(self.p)), 1e-300))


def lowered_words(column: pa.Array):
    """(first row, row after the last, words of the lower-cased texts) of each slice."""
    for a in range(0, len(column), 256):
        lowered = pa.array([None if t is None else t.lower() for t in column.slice(a, 256).to_pylist()], pa.large_string())
        for x, y, buf, bounds in slices(lowered):
            yield a + x, a + y, Words(buf, bounds, _NO_LETTER)


def distinct_words(column: pa.Array):
    """(first row, row after the last, distinct words, which of them have a letter, for each word of the slice its number, its row) of each slice."""
    for a, b, words in lowered_words(column):
        _, first, number = np.unique(words.code, return_index=True, return_inverse=True)
        texts = [words.buf[words.start[i] : words.end[i]].tobytes() for i in first.tolist()]
        good = np.array([t.isascii() or any(c.isalpha() for c in t.decode(errors="replace")) for t in texts], dtype=bool)
        yield a, b, texts, good, number, words.row_of()


def _parts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Marked words in parts of bounded length, and the word of each part."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        marked = b" " + text
        for k in range(0, len(marked), PART):
            parts.append(marked[k : k + PART])
            owner.append(i)
    return parts, np.array(owner, dtype=np.int64)


class WordScores:
    """Scores of the words met so far, by hash; it starts anew when it holds ``bound`` words, so memory stays bounded."""

    def __init__(self, model: Model, bound: int = 400_000):
        self.model, self.bound = model, bound
        self.codes, self.values = np.zeros(0, dtype=np.uint64), np.zeros((0, len(model.languages)))

    def of(self, codes: np.ndarray, text_of) -> np.ndarray:
        """A row of scores for each of the sorted ``codes``; NaN for words without a letter. ``text_of`` gives the bytes of the i-th."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
        new = np.flatnonzero(~known)
        if not len(new):
            return self.values[at]
        texts = [text_of(i) for i in new.tolist()]
        lettered = np.array([t.isascii() or any(c.isalpha() for c in t.decode(errors="replace")) for t in texts], dtype=bool)
        values = np.full((len(new), self.values.shape[1]), np.nan)
        if lettered.any():
            parts, owner = _parts([t for t, good in zip(texts, lettered, strict=True) if good])
            first = np.searchsorted(owner, np.arange(int(lettered.sum())))
            values[lettered] = np.add.reduceat(self.model.log_words(parts), first, axis=0)
        out = np.empty((len(codes), values.shape[1]))
        out[known] = self.values[at[known]]
        out[new] = values
        if len(self.codes) + len(new) > self.bound:
            self.codes, self.values = codes[new], values
        else:
            place = np.searchsorted(self.codes, codes[new])
            self.codes, self.values = np.insert(self.codes, place, codes[new]), np.insert(self.values, place, values, axis=0)
        return out


def score_texts(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    n_languages = len(model.languages)
    total, seen = np.zeros((len(column), max(1, n_languages))), np.zeros(len(column), dtype=bool)
    for a, b, words in lowered_words(column) if n_languages else ():
        if not len(words):
            continue
        codes, first, number = np.unique(words.code, return_index=True, return_inverse=True)
        logs = model.scores.of(codes, lambda i, w=words, f=first: w.buf[w.start[f[i]] : w.end[f[i]]].tobytes())[number]
        used = ~np.isnan(logs[:, 0])
        rows = words.row_of()[used]
        for k in range(n_languages):
            total[a:b, k] += np.bincount(rows, logs[used, k], b - a)
        seen[a + np.unique(rows)] = True
    share = np.exp(total - total.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    return [model.languages[k] if s else "und" for k, s in zip(best, seen, strict=True)], np.where(seen, share.max(1), 0.0)


def fit(words: dict[str, dict[bytes, int]], pieces: list[bytes], settings: Settings = Settings()) -> Model:
    """Piece probabilities from the word counts of each language."""
    languages, index = sorted(words), piece_index(pieces)
    p = np.zeros((len(pieces), len(languages)))
    for k, language in enumerate(languages):
        parts, owner = _parts(list(words[language]))
        weight = np.array(list(words[language].values()), dtype=float)[owner]
        lattice = Lattice(parts, index)
        own = np.full((len(pieces), 1), 1.0 / len(pieces))
        word_of = np.searchsorted(lattice.base, lattice.start, side="right") - 1
        for _ in range(settings.rounds):
            forward, backward = lattice.forward(own), lattice.backward(own)
            whole = np.maximum(lattice.whole(forward)[:, 0], 1e-300)
            use = forward[lattice.start, 0] * own[lattice.piece, 0] * backward[lattice.end, 0] / whole[word_of] * weight[word_of]
            counts = np.bincount(lattice.piece, use, len(pieces)) + settings.smoothing
            own = (counts / counts.sum())[:, None]
        p[:, k] = own[:, 0]
    return Model(languages, pieces, p)


def word_counts(docs: DataFrame, settings: Settings = Settings()) -> dict[str, dict[bytes, int]]:
    """Words of at most ``settings.per_language`` documents of each language, with their counts."""
    known = docs.filter("doc_id is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a share of each language by hash comes first, several times what is wanted, so that few rows of one language meet
    n = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("_n")))  # one row a language
    share = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) * F.col("_n") <= 4 * settings.per_language + 64
    chosen = known.select("doc_id", "lang").join(n, "lang").filter(share).withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= settings.per_language).select("doc_id").distinct()
    # bounded by the number of languages: small enough to ship
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for a, _, texts, good, number, row in distinct_words(batch.column(batch.schema.get_field_index("text"))):
                if not len(number):
                    continue
                pairs, counts = np.unique(row * len(texts) + number, return_counts=True)
                row_no, word_no = pairs // len(texts), pairs % len(texts)
                used = good[word_no]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[a + i] for i in row_no[used].tolist()], pa.string()), pa.array([texts[i] for i in word_no[used].tolist()], pa.binary()), pa.array(counts[used].astype(np.int64))],
                    names=["lang", "word", "n"],
                )

    counted = rows.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    out: dict[str, dict[bytes, int]] = {}
    for lang, word, n in sorted(zip(counted["lang"], counted["word"], counted["n"], strict=True)):
        out.setdefault(lang, {})[word] = n
    return out


def train(docs: DataFrame, settings: Settings = Settings(), path: str = VOCABULARY) -> Model:
    return fit(word_counts(docs, settings), vocabulary(path), settings)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of each document with ``lang_pred`` and ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names, scores = score_texts(batch.column(batch.schema.get_field_index("text")), shipped.value)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    return add_columns(docs, work, "lang_pred string, score double", keep, ["text"])
