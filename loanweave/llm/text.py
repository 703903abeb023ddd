"""Whole Arrow batches of texts as numpy arrays: words, their hashes, runs of words.

Words are maximal runs of bytes other than ASCII white space. A hash depends on the bytes of
the word alone, so it is the same in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE = 1 << 21

_ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_bytes = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, SLICE + 65536)
        step = np.full(n, _ODD, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step[1:] = pow(_ODD, -1, 1 << 64)
        _inverse = np.multiply.accumulate(step)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    _tables(n)
    return _powers[:n], _inverse[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; no word crosses two texts."""
    solid = ~space[raw]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = off[1:-1]
    before[inner[inner < len(solid)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[(inner > 0) & (inner <= len(solid))] - 1] = False
    return starts, np.flatnonzero(solid & ~after) + 1


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words before each text (one more than
    texts)."""
    starts, ends = word_bounds(raw, off)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, off, "left")


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, ordered and apart. Memory beyond the result is
    bounded by the slice, however many bytes there are."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        a, b = starts[lo], ends[hi - 1]
        _tables(int(b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_bytes[raw[a:b]] * _powers[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mixed((sums[e] - sums[s]) * _inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case; all others as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def run_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and the number of runs before each text.

    A text of fewer than k words, but at least one, has one run: all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    before = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], runs)
    last = np.repeat(first[1:], runs)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        here = at + i
        inside = here < last
        value = words[np.minimum(here, max(len(words) - 1, 0))] if len(words) else out
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, value, np.uint64(0))
    return mixed(out), before


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one have about `limit` bytes, or are one text."""
    for batch in batches:
        _, off = text_buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
