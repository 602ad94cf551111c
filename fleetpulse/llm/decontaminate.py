"""Benchmark decontamination by the q-gram lemma.

Texts are compared as UTF-8 bytes, A-Z lower-cased and space runs made one space. Benchmark items are
cut into overlapping windows of ``WINDOW`` bytes (shorter items: of the next smaller multiple of 8).
A window of m bytes that occurs with at most e = m // 20 edits shares at least
m + 1 - Q * (e + 1) of its q-grams with the place it occurs at, on diagonals at most e apart. So

1. places where too few q-grams of any window are near each other are dropped,
2. shared q-grams are counted per window in overlapping bands of diagonals,
3. bands that meet the bound are verified by banded alignment with e edits.

Items of fewer than ``LEAST`` bytes after normalising hold too few q-grams for an edit budget: they are found where
they occur exactly, between word bounds (``WORD``: ASCII letters and digits, and all bytes of other characters).

The benchmark is read in blocks of bounded size; the documents pass through all blocks in one scan
without a shuffle, in any number of tasks.

Defined cases: null and empty texts hold nothing; items that are empty or spaces only, and items with a null id or
text, are skipped. Repeated items are reported
once by id. A clashing column of the input named items or contaminated is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, SPACE, Prefix, U, flat, runs

Q = 8
WINDOW, STEP, LEAST = 80, 40, 32
BLOCK_BYTES = 4 << 20
FOLD = np.where(SPACE, 32, LOWER).astype(np.uint8)
SCATTER = U(0x9E3779B97F4A7C15)
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def normalise(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    folded = FOLD[data]
    space = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bounds[:-1][bounds[:-1] < len(folded)]] = True
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for k in range(min(Q, n)):
        part = np.frombuffer(data, "<u8", (len(data) - k) // Q, k)
        out[k::Q] = part[:len(out[k::Q])]
    return out


class Short:
    """Items below ``LEAST`` bytes by length, found exactly between word bounds."""

    def __init__(self):
        self.items: dict[int, dict[bytes, list[int]]] = {}
        self.hashes: dict[int, list[int]] = {}

    def add(self, item: int, body: bytes) -> None:
        n = len(body)
        named = self.items.setdefault(n, {}).setdefault(body, [])
        if not named:
            self.hashes.setdefault(n, []).append(Prefix(np.frombuffer(body, np.uint8)).of(np.zeros(1, np.int64), np.array([n]))[0])
        named.append(item)

    def places(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) of every short item that occurs in a row."""
        if not self.items or not len(data):
            return []
        edge = np.ones(len(data) + 1, bool)  # no word runs across the place before a byte
        edge[1:-1] = ~(WORD[data[1:]] & WORD[data[:-1]])
        edge[bounds] = True
        sums, starts, found = Prefix(data), np.flatnonzero(edge[:-1]), []
        limit = bounds[np.searchsorted(bounds, starts, "right")]
        for n, bodies in self.items.items():
            at = starts[starts + n <= limit]
            at = at[edge[at + n]]
            at = at[np.isin(sums.of(at, at + n), np.array(self.hashes[n], U))]
            row = np.searchsorted(bounds, at, "right") - 1
            for r, a in zip(row.tolist(), at.tolist()):
                found += [(r, item) for item in bodies.get(data[a:a + n].tobytes(), ())]
        return found


class Windows:
    """q-gram index of the windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.length, self.text, self.short = [], [], [], Short()
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            body = normalise(raw, np.array([0, len(raw)]))[0]
            body = np.frombuffer(body.tobytes().strip(), np.uint8)
            m = min(WINDOW, len(body) // 8 * 8)
            if len(body) < LEAST:
                if len(body):
                    self.short.add(item, body.tobytes())
                continue
            for start in sorted({*range(0, len(body) - m + 1, STEP), len(body) - m}):
                self.item.append(item), self.length.append(m), self.text.append(body[start:start + m])
        self.length = np.array(self.length, np.int64)
        codes = [grams(t) for t in self.text]
        every = np.concatenate(codes) if codes else np.zeros(0, U)
        window = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.codes, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.window, self.offset = window[order], offset[order]
        bits = max(16, int(np.ceil(np.log2(max(len(self.codes), 1) * 32))))
        self.shift, self.maybe = U(64 - bits), np.zeros(1 << bits, bool)
        self.maybe[(self.codes * SCATTER) >> self.shift] = True

    def bound(self, m):
        """Edits allowed in m bytes, and the fewest q-grams a place with that many edits shares."""
        e = m // 20
        return e, m + 1 - Q * (e + 1)

    def places(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) of every window that occurs in a row."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = grams(data)
        if not len(codes) or not len(self.codes):
            return none
        hit = self.maybe[(codes * SCATTER) >> self.shift]
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        near = np.zeros(len(codes) + 1, np.int32)
        for m in np.unique(self.length):
            e, least = self.bound(int(m))
            reach = int(m) + e - Q + 1
            ends = np.minimum(np.arange(reach, reach + len(codes)), len(codes))
            dense = np.flatnonzero(sums[ends] - sums[:len(codes)] >= least)
            np.add.at(near, dense, 1)
            np.add.at(near, ends[dense], -1)
        at = np.flatnonzero(hit & (np.cumsum(near[:-1]) > 0))
        row = np.searchsorted(bounds, at, "right") - 1
        whole = at + Q <= bounds[row + 1]
        at, row = at[whole], row[whole]
        slot = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        known = self.codes[slot] == codes[at]
        at, row, slot = at[known], row[known], slot[known]
        count = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at, row, window = np.repeat(at, count), np.repeat(row, count), self.window[entry]
        diagonal = at - self.offset[entry]
        width = self.length[window] // 20 + 1
        band = diagonal // width
        # each diagonal lies in two bands of 2 * width
        keyed = np.concatenate([np.stack([row, window, band]), np.stack([row, window, band - 1])], axis=1)
        keyed, shared = np.unique(keyed, axis=1, return_counts=True)
        rich = shared >= self.length[keyed[1]] + 1 - Q * (self.length[keyed[1]] // 20 + 1)
        row, window, band = keyed[:, rich]
        if not len(row):
            return none
        good = np.zeros(len(row), bool)
        for m in np.unique(self.length[window]):
            some = np.flatnonzero(self.length[window] == m)
            good[some] = self.aligned(data, bounds, row[some], window[some], band[some], int(m))
        return row[good], window[good]

    def aligned(self, data, bounds, row, window, band, m: int) -> np.ndarray:
        """Whether a window of m bytes aligns within its edits in the diagonals of its band."""
        e, _ = self.bound(m)
        wide = 2 * (e + 1) + 2 * e
        start = band * (e + 1) - e
        at = start[:, None] + np.arange(m + wide)
        inside = (at >= bounds[row][:, None]) & (at < bounds[row + 1][:, None])
        text = np.where(inside, data[np.clip(at, 0, len(data) - 1)], -1).astype(np.int16)
        pattern = np.stack([self.text[w] for w in window]).astype(np.int16)
        steps = np.arange(wide)
        cost = np.zeros((len(row), wide), np.int32)  # of the pattern so far, ending on each diagonal
        for i in range(m):
            moved = cost + (text[:, i:i + wide] != pattern[:, i:i + 1])
            moved[:, :-1] = np.minimum(moved[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(moved - steps, axis=1) + steps
        return cost.min(axis=1) <= e


def _search(items: list[tuple[int, str]], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Windows(items)
        for batch in batches:
            data, bounds = flat(batch.column(column))
            found: list[set[int]] = [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in runs(bounds):
                folded = normalise(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                for r, w in zip(*index.places(*folded)):
                    found[a + int(r)].add(index.item[w])
                for r, item in index.short.places(*folded):
                    found[a + r].add(item)
            yield batch.set_column(batch.num_columns - 1, "items", pa.array([sorted(x) for x in found], pa.list_(pa.int64())))

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``items``, the ids of the benchmark items they hold, and ``contaminated``."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = docs.drop("items", "contaminated").withColumn("items", F.array().cast("array<long>"))
    place, schema = out.columns.index("text"), out.schema
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about block_bytes
        out = out.mapInArrow(_search([tuple(r) for r in block], place), schema)
    return out.withColumn("contaminated", F.size("items") > 0)
