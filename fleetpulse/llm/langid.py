"""Language of texts by a linear-chain conditional random field over their words.

A word's emission score sums learned weights of its byte n-grams (two to four bytes, word ends
included), affixes and its lexicon entry, all in hashed tables; transitions between the labels of
neighbouring words are learned too. Forward-backward gives each word's label marginals, so a text that
switches language is labelled word by word. A text's label is the one with the largest sum of
marginals, its score their mean. Chains are runs of ``CHAIN`` words; every word of every text is in one.

The field is fitted on whole texts of at most ``sample_docs`` documents in all, chosen by hash in equal
shares of each language; their words take the document's label. The fit is a bounded number
of passes on the driver; labelling is one scan without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Words without letters have no
part in a chain. Rows with a null lang are labelled and not learned from; a null doc_id is not held out.
Repeated rows get equal labels. Where nothing can be learned every label is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, Prefix, U, flat, runs, word_bounds

CHAIN = 64
BITS = 16
FAMILIES = 7
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _beside(data: np.ndarray, bounds: np.ndarray, by: int) -> np.ndarray:
    """The byte ``by`` places further in the same text, or a space."""
    out = np.full(len(data), 32, np.uint32)
    if by > 0:
        out[:-by] = data[by:]
        for k in range(by):
            at = bounds[1:] - 1 - k
            out[at[at >= bounds[:-1]]] = 32
    else:
        out[-by:] = data[:by]
        for k in range(-by):
            at = bounds[:-1] + k
            out[at[at < bounds[1:]]] = 32
    return out


def _slot(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)


class Words:
    """Words with letters of some texts: chain places and feature slots."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        low = LOWER[data]
        start, end, _ = word_bounds(low, bounds)
        letters = np.concatenate([[0], np.cumsum(LETTER[low], dtype=np.int64)])
        some = letters[end] > letters[start]
        self.start, self.end = start[some], end[some]
        self.row = np.searchsorted(bounds, self.start, "right") - 1
        first = np.searchsorted(self.row, np.arange(len(bounds) - 1))
        self.order = np.arange(len(self.start)) - first[self.row]
        one = low.astype(np.uint32)
        a, b, c = _beside(low, bounds, -1), _beside(low, bounds, 1), _beside(low, bounds, 2)
        self.byte_slots = [_slot(one << np.uint32(8) | b), _slot((a << np.uint32(16) | one << np.uint32(8) | b) + np.uint32(1)),
                           _slot((a << np.uint32(24) | one << np.uint32(16) | b << np.uint32(8) | c) + np.uint32(7))]
        prefix = Prefix(low)
        hashed = lambda s, e: (prefix.of(s, e) >> U(64 - BITS)).astype(np.int32)
        self.word_slots = [hashed(self.start, np.minimum(self.start + 3, self.end)), hashed(np.maximum(self.end - 2, self.start), self.end),
                           hashed(np.maximum(self.end - 3, self.start), self.end), hashed(self.start, self.end)]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Label scores of each word; ``weights`` is [family, slot, label]."""
        if not len(self.start):
            return np.zeros((0, weights.shape[2]), np.float32)
        per_byte = sum(weights[f][s] for f, s in enumerate(self.byte_slots))
        per_byte = np.vstack([per_byte, np.zeros((1, per_byte.shape[1]), np.float32)])
        inside = np.add.reduceat(per_byte, np.stack([self.start, self.end], 1).ravel(), axis=0)[::2]
        return inside + sum(weights[len(self.byte_slots) + f][s] for f, s in enumerate(self.word_slots))

    def chains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chain and place of each word, and the chain lengths."""
        place = self.order % CHAIN
        chain = np.cumsum(place == 0) - 1
        return chain, place, np.bincount(chain) if len(chain) else np.zeros(0, np.int64)


def forward_backward(emissions: np.ndarray, words: Words, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of each word, and the expected transition counts."""
    labels = emissions.shape[1]
    chain, place, lengths = words.chains()
    if not len(chain):
        return emissions, np.zeros((labels, labels))
    steps, n = int(lengths.max()), len(lengths)
    e = np.ones((steps, n, labels), np.float32)
    e[place, chain] = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-12
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    f, b = np.empty_like(e), np.ones_like(e)
    f[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    longer = lengths[None, :] > np.arange(steps)[:, None]
    for t in range(1, steps):
        x = (f[t - 1] @ a) * e[t]
        x /= x.sum(axis=1, keepdims=True)
        f[t] = np.where(longer[t][:, None], x, f[t - 1])
    for t in range(steps - 1, 0, -1):
        x = (e[t] * b[t]) @ a.T
        x /= x.sum(axis=1, keepdims=True)
        b[t - 1] = np.where(longer[t][:, None], x, 1.0)
    m = f * b
    m /= m.sum(axis=2, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(1, steps):
        on = longer[t]
        joint = f[t - 1][on][:, :, None] * a[None] * (e[t][on] * b[t][on])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return m[place, chain], pairs


def fit(texts: list[str], labels: list[int], n_labels: int, passes: int = 14, rate: float = 0.35) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by adaptive gradient ascent on the words' conditional likelihood."""
    weights, transitions = np.zeros((FAMILIES, 1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels))
    data, bounds = flat(pa.array(texts, pa.large_string()))
    parts = [(Words(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]), np.array(labels[a:b])) for a, b in runs(bounds)]
    gw, gt = np.full_like(weights, 1e-3), np.full_like(transitions, 1e-3)
    for _ in range(passes):
        for words, truth in parts:
            if not len(words.start):
                continue
            marginals, pairs = forward_backward(words.emissions(weights), words, transitions)
            y = truth[words.row]
            miss = -marginals
            miss[np.arange(len(y)), y] += 1
            inner = np.zeros(len(words.byte_slots[0]), np.int64) - 1
            inner[words.start] = np.arange(len(words.start))
            spread = np.repeat(miss, words.end - words.start, axis=0)
            inside = np.concatenate([np.arange(s, e) for s, e in zip(words.start, words.end)])
            n = len(y)
            for f in range(FAMILIES):
                slot, value = (words.byte_slots[f][inside], spread) if f < len(words.byte_slots) else (words.word_slots[f - len(words.byte_slots)], miss)
                for k in range(n_labels):
                    g = (np.bincount(slot, value[:, k], 1 << BITS) / n).astype(np.float32)
                    gw[f, :, k] += g * g
                    weights[f, :, k] += rate * g / np.sqrt(gw[f, :, k])
            chain, place, _ = words.chains()
            seen = np.zeros_like(transitions)
            later = np.flatnonzero(place > 0)
            np.add.at(seen, (y[later - 1], y[later]), 1)
            g = (seen - pairs) / n
            gt += g * g
            transitions += rate * g / np.sqrt(gt)
    return weights, transitions


def _label(labels: list[str], weights: np.ndarray, transitions: np.ndarray, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(column))
            names, scores = np.full(len(bounds) - 1, "und", object), np.zeros(len(bounds) - 1)
            for a, b in runs(bounds):
                words = Words(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                marginals, _ = forward_backward(words.emissions(weights), words, transitions)
                sums = np.stack([np.bincount(words.row, marginals[:, k], b - a) for k in range(len(labels))], 1)
                n = np.bincount(words.row, minlength=b - a)
                for r in np.flatnonzero(n):
                    best = int(sums[r].argmax())
                    names[a + r], scores[a + r] = labels[best], min(1.0, sums[r, best] / n[r])
                for r in np.flatnonzero(n):  # bytes beyond ASCII need not be letters
                    raw = data[bounds[a + r]:bounds[a + r + 1]]
                    if not LETTER[:128][raw[raw < 128]].any() and not any(c.isalpha() for c in raw.tobytes().decode()):
                        names[a + r], scores[a + r] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def label_languages(docs: DataFrame, carry: list[str], sample_docs: int = 1200, held_fold: int = 2) -> DataFrame:
    """Columns ``carry`` of ``docs`` with held_out, lang_pred and score."""
    learn = docs.where(fold_of(F.col("doc_id")) != held_fold).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in learn.groupBy("lang").count().collect()}  # one row per language
    labels = sorted(sizes)
    held = (fold_of(F.col("doc_id")) == held_fold).alias("held_out")
    out = docs.select(*[c for c in carry if c not in ("held_out", "lang_pred", "score", "text")], held, "text")
    if not labels:
        return out.drop("text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    share = sample_docs // len(labels) + 1
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < share / n))
    rows = learn.where(chosen).select("lang", "text", "doc_id").limit(2 * sample_docs).collect()
    rows = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1]))
    weights, transitions = fit([r[1] for r in rows], [labels.index(r[0]) for r in rows], len(labels))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(_label(labels, weights, transitions, out.columns.index("text")), f"{types}, lang_pred string, score double").drop("text")
