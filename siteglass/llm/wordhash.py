"""Words and shingles of many texts at once, as numpy arrays.

Words are runs of bytes other than space and \\t..\\r, lower-cased in A-Z. Each gets a 64-bit hash
from a polynomial prefix sum modulo 2**64 over random byte values, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240917)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = _VALUES[_LOWER]
SLICE_BYTES = 1_000_000
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, U(b))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Polynomial prefix sums: data[a:b] has the hash (h[b] - h[a]) * base**-a."""
    h = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * powers(max(len(data), 1))[0], out=h[1:])
    return h


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets from 0) of runs of rows, most bytes each or one row; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, hash of each word), in order."""
    row, _, _, h = word_spans(data, off)
    return row, h


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, past the last byte, hash) of each word, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    h = prefix(data, _LOWER_VALUES)
    return np.searchsorted(off, s, "right") - 1, s, e, mix((h[e] - h[s]) * powers(n)[1][s] + (e - s).astype(U))


_MULT = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row. Fewer words than width: the whole sequence is one shingle."""
    for a, b, data, off in text_slices(texts):
        row, w = words(data, off)
        count = np.bincount(row, minlength=b - a)
        at = np.concatenate([[0], np.cumsum(count)])
        m = max(0, len(w) - width + 1)
        h = np.zeros(m, U)
        for i in range(width):
            h += w[i : i + m] * _MULT[i % 16] + U(i // 16)
        h = mix(h)
        for r in range(b - a):
            n = count[r]
            if n >= width:
                yield a + r, np.unique(h[at[r] : at[r + 1] - width + 1])
            elif n:
                one = np.zeros(1, U)
                for i in range(n):
                    one += w[at[r] + i : at[r] + i + 1] * _MULT[i % 16] + U(i // 16)
                yield a + r, mix(one + U(int(n) * 0xD1342543DE82EF95 % 2**64))
            else:
                yield a + r, np.zeros(0, U)
