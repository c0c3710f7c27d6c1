"""Words of UTF-8 text as numpy arrays, for use inside Spark tasks.

A slice of a column is seen as one byte buffer with the offsets of its rows. Word
bounds come from a table over the 256 byte values, and every word gets a 64-bit
polynomial hash from one running sum. Hashes of runs of words come from a second
running sum over the word hashes, so any window length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; numpy scratch is about 20 times that. A longer row is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RUN_BASE = np.uint64(0xD1342543DE82EF95)
_RUN_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def byte_table(members: bytes) -> np.ndarray:
    """True for the byte values in ``members``."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


# [\x20\x09-\x0D]
BLANKS = byte_table(b" \t\n\x0b\x0c\r")
# all that is no digit, small letter or part of a non-ASCII character
NO_WORD = byte_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were ever asked for."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]), dtype=np.uint64)
        return self.up, self.down


_BYTES, _RUNS = _Powers(_BASE, _INVERSE), _Powers(_RUN_BASE, _RUN_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null row is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, bounds - bounds[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of successive pieces of at most ``limit`` bytes or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    buf, bounds = row_buffer(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, stop, buf[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
        at = stop


class Words:
    """The words of some rows: ``start`` and ``end`` in bytes, ``code`` (64-bit hash), ``first`` (word index where each row begins)."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANKS, hashed: bool = True):
        self.buf, self.bounds = buf, bounds
        inside = ~separators[buf]
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[bounds] = True
        before = np.concatenate([[False], inside[:-1]]) if len(buf) else inside
        after = np.concatenate([inside[1:], [False]]) if len(buf) else inside
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.code = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        code = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):  # pieces that begin and end between words keep the scratch small
            low = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, low + SLICE_BYTES, side="right")))
            high = self.end[stop - 1]
            up, down = _BYTES.get(int(high - low) + 1)
            total = np.empty(high - low + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum((self.buf[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
            a, b = self.start[at:stop] - low, self.end[at:stop] - low
            code[at:stop] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            at = stop
        return code

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def running(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``window_codes`` needs; computed once for all window lengths."""
        up, down = _RUNS.get(len(self) + 1)
        total = np.zeros(len(self) + 1, dtype=np.uint64)
        np.cumsum(self.code * up[: len(self)], out=total[1:])
        return total, down

    def window_codes(self, length: int, running: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starting words of the windows of ``length`` words inside one row, and the hashes of the windows."""
        total, down = running or self.running()
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self))
        at = np.flatnonzero(left >= length)
        return at, mix((total[at + length] - total[at]) * down[at] + np.uint64(length))

    def joined(self, a: int, b: int, glue: bytes = b" ") -> bytes:
        """The words a to b-1 with ``glue`` between them."""
        return glue.join(self.buf[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per word or byte) in each row; ``first`` holds the row bounds."""
    if flags.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(flags), first))
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
