"""Whole texts as numpy bytes: word bounds and hashes for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Rows are worked on in runs of about so many bytes.
RUN = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


class _Held(dict):
    """A cache that travels to other processes empty."""

    def __reduce__(self):
        return _Held, ()


_powers = _Held()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, RUN * 2), base % 2**64, U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row bounds in them; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def runs(bounds: np.ndarray, most: int = RUN) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes each; every row is in one."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b
        a = b


class Prefix:
    """Hashes of any ranges of a buffer, of bytes or of 64-bit values, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        values = VALUES[data] if data.dtype == np.uint8 else data
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = powers(pow(BASE, -1, 2**64), n + 1)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[first]) * self.inverse[first] + (end - first).astype(U))


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the number of words before each row bound."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


class WordPrefix(Prefix):
    """Hashes of any runs of words of a buffer, with the words' bytes and the number of words before each row bound."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.first, self.end, self.before = word_bounds(data, bounds)
        super().__init__(Prefix(data).of(self.first, self.end))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row, ascending; of all words where there are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = np.zeros(n - k + 1, U)
    for j in range(k):
        total = mixed(total + words[j:n - k + 1 + j])
    return np.unique(total + U(width - k))
