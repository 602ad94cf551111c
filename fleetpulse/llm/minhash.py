"""Near duplicates by b-bit MinHash.

Documents with equal shingle sets form a class (the class id is its smallest doc_id). Each
class has minima under ``BANDS * ROWS`` hash functions. Band keys of whole minima give candidates;
the lowest ``BITS`` bits of the minima, packed into longs, give an estimate of similarity by bit
counts, corrected for equal bits by chance. Candidates whose estimate is not far below the
threshold are confirmed on full shingle sets.

Links are found in two passes. First each class is compared with the most central class among its
buckets, the one that shares buckets with the most others: that joins the bulk of every group with as many
pairs as classes. Then the classes of buckets that still hold several components are compared in full: those
that buckets connect are cut into blocks, and each pair of blocks is one task that multiplies
incidence matrices and returns no more links than classes, so no link is left out and no pair is a row. A pair of similarity 0.75 misses every one of 64 bands of 6 with probability below 4e-6.

Defined cases: a text without words has an empty set, is linked with nothing and kept. Rows that share
a doc_id share a class id, so their classes are one. A null doc_id has no component; such a row is linked
with nothing and kept. Repeated rows come out as often as they came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, Prefix, flat, runs, shingles, word_bounds
from .graph import components
from .tables import stored

WIDTH = 5
BANDS, ROWS, BITS = 64, 6, 2
LANES = BANDS * ROWS
LONGS = LANES * BITS // 64
#: So far below the threshold an estimate may lie: over five standard deviations.
MARGIN = 0.15
#: Classes of a block, and shingles whose incidence is held at once.
BLOCK, COLUMNS = 256, 4096
#: Bytes of a shingle hash in the sets that are compared: within two sets, equal by chance once in 2 ** 48 pairs.
KEPT = 6
_rng = np.random.default_rng(7)
MASKS = _rng.integers(0, 2**32, LANES, dtype=np.uint32)
ODD = _rng.integers(0, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MIX = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 5-word shingle hashes of each row."""
    data, bounds = flat(column)
    for a, b in runs(bounds):
        part = LOWER[data[bounds[a]:bounds[b]]]
        starts, ends, rows = word_bounds(part, bounds[a:b + 1] - bounds[a])
        hashes = Prefix(part).of(starts, ends)
        for i in range(b - a):
            yield shingles(hashes[rows[i]:rows[i + 1]], WIDTH)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of a set under each hash function."""
    low = np.full(LANES, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        x = short[k:k + 512][None, :] ^ MASKS[:, None]
        x *= ODD[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima in longs."""
    bits = (low.astype(np.uint64) & np.uint64((1 << BITS) - 1)).reshape(LONGS, -1)
    return (bits << (np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    keys = (low.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * MIX
    keys ^= keys >> np.uint64(29)
    keys = keys.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def _lists(rows: list[np.ndarray], per_row: int) -> pa.Array:
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, per_row), pa.int32()), pa.array(values))


def _set_digest(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in shingle_sets(batch.column(1))], pa.int64())], names=["doc_id", "n_shingles"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures and band keys; a set met before in the same partition is skipped."""
    for batch in batches:
        ids, sizes, digests, packed, keys, seen = [], [], [], [], [], set()
        for i, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
            digest = _set_digest(hashes)
            if not len(hashes) or i is None or (i, digest) in seen:
                continue
            seen.add((i, digest))
            low = minima(hashes)
            ids.append(i), sizes.append(len(hashes)), digests.append(digest), packed.append(pack(low)), keys.append(band_keys(low))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(packed, LONGS), _lists(keys, BANDS)],
                                         names=["doc_id", "n", "digest", "packed", "keys"])


def _cut(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def _whole(blob: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, KEPT)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :KEPT] = raw
    return np.unique(out.view(np.uint64).ravel())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_cut(s) for s in shingle_sets(batch.column(1))], pa.binary())], names=["id", "hashes"])


def _shared(threshold: int):
    """Pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _whole(x), _whole(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures: equal lanes by bit counts, less those equal by chance."""
    lowest = F.lit(0x5555555555555555)  # one bit of each lane
    unequal = None
    for k in range(LONGS):
        d = x[k].bitwiseXOR(y[k])
        n = F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(lowest))
        unequal = n if unequal is None else unequal + n
    chance = 2.0 ** -BITS
    return (1 - unequal / LANES - chance) / (1 - chance)


def _plausible(x: Column, y: Column, nx: Column, ny: Column, threshold: int) -> Column:
    return (100 * F.least(nx, ny) >= threshold * F.greatest(nx, ny)) & (estimate(x, y) >= threshold / 100 - MARGIN)


def confirm(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "hashes": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_shared(threshold), "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    on = shared[column]
    row, column = row[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        incidence = np.zeros((len(sets), COLUMNS), np.float32)
        incidence[row[a:b], column[a:b] - k] = 1
        out += incidence @ incidence.T
    return out.astype(np.int64)


def _compare_blocks(threshold: int):
    """Links between classes of different components in a pair of blocks: a forest of them."""
    def run(rows: pa.Table) -> pa.Table:
        ids, parts, blocks = (rows[c].to_numpy() for c in ("id", "component", "block"))
        sets = [_whole(x) for x in rows["hashes"].combine_chunks()]
        size, both = np.array([len(s) for s in sets]), overlaps(sets)
        good = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
        good &= (parts[:, None] != parts[None, :]) & ((blocks[:, None] != blocks[None, :]) | (rows["x"][0].as_py() == rows["y"][0].as_py()))
        root = {p: p for p in parts.tolist()}
        out = []
        for i, j in zip(*np.nonzero(np.triu(good, 1))):
            p, q = parts[i], parts[j]
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[p] = q
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def compare_rest(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links among (key, id, component) rows of buckets that hold several components."""
    least = members.groupBy("key").agg(F.min("id").alias("b"))
    groups = components(members.join(least, "key").select(F.col("id").alias("a"), "b"))
    held = members.select("id", "component").distinct().join(groups.withColumnRenamed("component", "cluster"), "id")
    held = stored(held, "split-classes")
    blocks = held.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = held.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("id", "component", "cluster", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return sent.join(sets, "id").groupBy("cluster", "x", "y").applyInArrow(_compare_blocks(threshold), "a long, b long")


def link(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """(doc_id, component) of the documents that are not alone."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(base.mapInArrow(_signatures, "doc_id long, n long, digest binary, packed array<long>, keys array<long>"), "signatures")
    first = signed.groupBy("digest").agg(F.min("doc_id").alias("id"))
    copies = signed.select("doc_id", "digest").join(first, "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    # equal sets are linked already; one row of each goes on
    classes = signed.join(first.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"], "left_semi")
    keys = classes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("held")).where("least < most")
    buckets = stored(keys.join(shared.select("key", "held"), "key"), "buckets")
    ranked = buckets.join(buckets.groupBy("id").agg(F.sum("held").alias("weight")), "id").select("key", "id", F.struct("weight", (-F.col("id")).alias("least")).alias("rank"))
    centres = ranked.groupBy("key").agg(F.max("rank").alias("centre"))
    stars = ranked.join(centres, "key").where("rank <> centre").groupBy("id").agg(F.max("centre").alias("centre"))
    stars = stars.select(F.col("id").alias("a"), (-F.col("centre.least")).alias("b"))
    packed = classes.select(F.col("doc_id").alias("id"), "n", "packed")
    named = lambda s: packed.withColumnsRenamed({"id": s, "n": f"n{s}", "packed": f"p{s}"})
    plausible = _plausible(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"), threshold)
    stars = stars.join(named("a"), "a").join(named("b"), "b").where(plausible).select("a", "b").distinct()
    texts = base.join(buckets.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(_sets, "id long, hashes binary"), "sets")
    links = stored(copies.unionByName(confirm(sets, stars, threshold)), "links")
    part = components(links)
    at = buckets.select("key", "id").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = stored(at.join(split, "key", "left_semi"), "split-buckets")
    return components(links.unionByName(compare_rest(rest, sets, threshold))).withColumnRenamed("id", "doc_id")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = base.mapInArrow(_sizes, "doc_id long, n_shingles long")
    component = F.coalesce("component", "doc_id")
    return sizes.join(link(docs, threshold), "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """``docs`` less all but the smallest doc_id of each component."""
    gone = link(docs, threshold).where("doc_id <> component").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
