"""Long repeats by distributed difference-cover suffix sorting, cut off at the repeat length.

Two suffixes belong together if their first ``length`` bytes agree. A difference cover of period ``v`` has a
residue for each of two positions to land on after one and the same shift below v, so suffixes that
agree on ``length`` bytes lead to sampled positions that agree on ``length - v + 1``. Hence

1. sampled suffixes are named by their first length - v + 1 bytes, and names are ordered in buckets; equal names
   are adjacent, and suffixes with a name of their own drop out. Names are already longer than the
   part of a suffix that a second level would compare, so the recursion ends here,
2. the remaining suffixes, those that lead to a repeated name within v bytes, are merged: ordered by their
   first ``length`` bytes, where equal adjacent prefixes mark a repeat.

Order means order of fingerprints of the prefixes: only the adjacency of equal prefixes matters. Names use 40 bits
(a chance equality only lets a suffix remain), final prefixes 64 bits: one false equality is expected at about
six thousand million remaining suffixes. Fingerprints that repeat within a worker's batch are sent once and known
to repeat; the others travel as packed blobs, one row per batch and bucket. The second round first brings texts
with the same names together, so that most repeats meet in their own batch. No step holds more than a bucket.

The same two rounds, with words in place of bytes, find passages: runs of words covered by ``words`` words in a
row that another document has too, whatever their bytes. There a text's equal runs are sent once, so that
repeats within a text are no passages.

A text is identified by a 64-bit digest; copies of a text are told by their number and share the rest.

Defined cases: null and empty texts have nothing to remove. All copies of a text of at least ``length`` bytes are removed
whole, rows with equal or null doc_ids included; a text of at least ``words`` words that has copies is one passage.
Matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U, Prefix, WordPrefix, flat, runs
from .tables import stored

FLUSH = 1_000_000
BUCKET_BYTES = 16 << 20
#: Passages are runs of over 50 words.
PASSAGE_WORDS = 51
#: Words count as of so many bytes when buckets are dealt; of one-letter words a bucket holds twice as much.
WORD_BYTES = 4


def difference_cover(v: int) -> np.ndarray:
    """Residues modulo v whose differences reach every shift: a prefix of small steps and multiples of a larger one."""
    step = int(np.ceil(np.sqrt(v / 2)))
    cover = {*range(step), *range(2 * step - 1, v // 2 + step + 1, step)} | {0}
    cover = {c % v for c in cover}
    for d in range(v):  # whatever shift is still missing
        if not any((c + d) % v in cover for c in cover):
            cover.add(d)
    cover = sorted(cover)
    for c in list(cover):  # drop what is not needed
        rest = set(cover) - {c}
        if len({(a - b) % v for a in rest for b in rest}) == v:
            cover = sorted(rest)
    return np.array(cover)


#: A perfect difference set: every shift modulo 133 is the difference of exactly one pair. Fixed values.
PERFECT_133 = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: The same modulo 21.
PERFECT_21 = (0, 1, 4, 14, 16)


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """Period and cover for a repeat length; the period leaves most of the length to the names."""
    for v, perfect in ((133, PERFECT_133), (21, PERFECT_21)):
        if length >= 2 * v:
            return v, np.array(perfect)
    return (max(2, length // 3), difference_cover(max(2, length // 3))) if length > 1 else (1, np.array([0]))


def in_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[Prefix, np.ndarray]:
    """Hashes of the byte ranges of some texts, and the texts' bounds."""
    return Prefix(data), bounds


def in_words(data: np.ndarray, bounds: np.ndarray) -> tuple[WordPrefix, np.ndarray]:
    """The same in words."""
    words = WordPrefix(data, bounds)
    return words, words.before


def sampled(n: int, length: int, v: int, cover: np.ndarray) -> np.ndarray:
    """Sampled positions of a text of n bytes that have a whole name."""
    last = n - (length - v + 1)
    if last < 0 or n < length:
        return np.zeros(0, np.int64)
    every = (np.arange(last // v + 1)[:, None] * v + cover).ravel()
    return every[every <= last]


def remaining(n: int, length: int, v: int, repeated: np.ndarray) -> np.ndarray:
    """Positions that lead to a repeated name within v bytes and have a whole prefix."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(repeated - v + 1, 0), 1)
    np.add.at(edge, repeated + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    return at[at <= n - length]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(40)) * U(buckets) >> U(24)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # 16 bits are sorted by their digits


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' places bucket by bucket, each in its order, and the buckets' bounds among them."""
    return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def _cut(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _keys(blob: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


SENT = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("repeated", pa.binary()), ("single", pa.binary()), ("shared", pa.binary())])
SENT_DDL = "bucket int, owners binary, counts binary, repeated binary, single binary, shared binary"


def _send(owners: list[int], keys: list[np.ndarray], buckets: int, width: int) -> pa.RecordBatch:
    """One row per bucket: the texts in it, how many keys each has there, which of them repeat in
    this batch, the other keys, and one of each repeating key."""
    every = np.concatenate(keys) if keys else np.zeros(0, U)
    text = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(every)
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(every), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = twice.copy()
    first[1:] &= ~same
    shared = ranked[first]
    repeated = np.empty(len(every), bool)
    repeated[order] = twice
    by, bounds = _dealt(bucket_of(every, buckets), buckets)
    shared_bounds = np.searchsorted(bucket_of(shared, buckets), np.arange(buckets + 1))
    owner = np.array(owners, np.int64)
    rows = []
    for b in np.flatnonzero(np.diff(bounds)):
        at = by[bounds[b]:bounds[b + 1]]
        starts = np.flatnonzero(np.append(True, np.diff(text[at]) != 0))
        counts = np.diff(np.append(starts, len(at)))
        rows.append({"bucket": int(b), "owners": owner[text[at[starts]]].tobytes(), "counts": counts.astype("<u4").tobytes(), "repeated": np.packbits(repeated[at]).tobytes(),
                     "single": _cut(every[at[~repeated[at]]], width), "shared": _cut(shared[shared_bounds[b]:shared_bounds[b + 1]], width)})
    return pa.RecordBatch.from_pylist(rows, SENT)


def _sender(keys_of, buckets: int, width: int, units):
    """Packs the keys of (owner, text, ...) rows; ``keys_of(prefix, first, end, *extra)`` gives a text's keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, keys, held = [], [], 0
        for batch in batches:
            data, bounds = flat(batch.column(1))
            extra = [c.to_pylist() for c in batch.columns[2:]]
            names = batch.column(0).to_pylist()
            for a, b in runs(bounds):
                prefix, at = units(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                for i in range(a, b):
                    k = keys_of(prefix, at[i - a], at[i - a + 1] - at[i - a], *[e[i] for e in extra])
                    if len(k):
                        owners.append(names[i]), keys.append(k)
                        held += len(k)
                if held >= FLUSH:
                    yield _send(owners, keys, buckets, width)
                    owners, keys, held = [], [], 0
        if held:
            yield _send(owners, keys, buckets, width)

    return run


TOLD = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("flags", pa.binary())])
MARKS = pa.list_(pa.struct([("bucket", pa.int32()), ("flags", pa.binary())]))


def _sort_bucket(width: int, parts: int):
    """Orders all keys of a bucket and tells, per text, which of its keys have an equal neighbour."""
    def run(rows: pa.Table) -> pa.Table:
        singles = [_keys(x, width) for x in rows["single"].to_pylist()]
        single = np.concatenate(singles)
        every = np.concatenate([single, *[_keys(x, width) for x in rows["shared"].to_pylist()]])
        order = np.argsort(every)
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        equal = np.zeros(len(every), bool)
        equal[order[1:]] |= same
        equal[order[:-1]] |= same
        seen, told, at = set(), [], 0
        for owners, counts, repeated, own in zip(rows["owners"].to_pylist(), rows["counts"].to_pylist(), rows["repeated"].to_pylist(), singles):
            counts = np.frombuffer(counts, "<u4").astype(np.int64)
            flags = np.unpackbits(np.frombuffer(repeated, np.uint8), count=counts.sum()).astype(bool)
            flags[~flags] = equal[at:at + len(own)]
            at += len(own)
            ends = np.cumsum(counts)
            owners = np.frombuffer(owners, np.int64)
            for k in np.flatnonzero(np.add.reduceat(flags, ends - counts)):
                if owners[k] not in seen:  # copies of a text get equal flags
                    seen.add(owners[k])
                    told.append((int(owners[k]) % parts, int(owners[k]), np.packbits(flags[ends[k] - counts[k]:ends[k]]).tobytes()))
        bucket, out = rows["bucket"][0].as_py(), []
        for part in sorted({t[0] for t in told}):
            own = [t for t in told if t[0] == part]
            out.append({"part": part, "bucket": bucket, "owners": np.array([t[1] for t in own], np.int64).tobytes(),
                        "sizes": np.array([len(t[2]) for t in own], "<u4").tobytes(), "flags": b"".join(t[2] for t in own)})
        return pa.Table.from_pylist(out, TOLD)

    return run


def _by_text(rows: pa.Table) -> pa.Table:
    """The flags of each text of a part, from all buckets."""
    marks: dict[int, list] = {}
    for r in rows.to_pylist():
        at = 0
        for owner, size in zip(np.frombuffer(r["owners"], np.int64).tolist(), np.frombuffer(r["sizes"], "<u4").tolist()):
            marks.setdefault(owner, []).append({"bucket": r["bucket"], "flags": r["flags"][at:at + size]})
            at += size
    return pa.table({"owner": pa.array(list(marks), pa.int64()), "marks": pa.array(list(marks.values()), MARKS)})


def equal_neighbours(rows: DataFrame, keys_of, buckets: int, width: int, name: str, units=in_bytes) -> DataFrame:
    """(owner, marks): for every text with a repeated key, its (bucket, flags) list. Flags come
    back packed by part of the texts, so rows grow with buckets and parts, not with their product with texts."""
    sent = rows.mapInArrow(_sender(keys_of, buckets, width, units), SENT_DDL)
    told = sent.groupBy("bucket").applyInArrow(_sort_bucket(width, buckets), "part int, bucket int, owners binary, sizes binary, flags binary")
    return stored(told.groupBy("part").applyInArrow(_by_text, "owner long, marks array<struct<bucket:int,flags:binary>>"), name)


def flagged(keys: np.ndarray, marks: list, buckets: int) -> np.ndarray:
    """Which of a text's keys are flagged in ``marks``."""
    by, bounds = _dealt(bucket_of(keys, buckets), buckets)
    out = np.zeros(len(keys), bool)
    for mark in marks:
        b, flags = mark["bucket"], mark["flags"]
        at = by[bounds[b]:bounds[b + 1]]
        out[at] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(at)).astype(bool)
    return out


def _named(length: int, v: int, cover: np.ndarray):
    def keys_of(prefix: Prefix, first: int, n: int) -> np.ndarray:
        at = sampled(n, length, v, cover) + first
        return prefix.of(at, at + (length - v + 1))

    return keys_of


def _positions(keys_of, length: int, v: int, cover: np.ndarray, buckets: int, units):
    """Repeated sampled positions of each text, and its least repeated name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(1))
            marks, places, least = batch.column(2).to_pylist(), [], []
            for a, b in runs(bounds):
                prefix, at = units(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                for i in range(a, b):
                    n = int(at[i - a + 1] - at[i - a])
                    keys = keys_of(prefix, at[i - a], n)
                    on = flagged(keys, marks[i], buckets)
                    places.append(sampled(n, length, v, cover)[on].astype("<u4").tobytes()), least.append(int(keys[on].min() >> U(1)) if on.any() else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(least, pa.int64()), batch.column(3)], names=["owner", "text", "places", "least", "copies"])

    return run


def _merged(length: int, v: int):
    def keys_of(prefix: Prefix, first: int, n: int, places: bytes) -> np.ndarray:
        at = remaining(int(n), length, v, np.frombuffer(places, "<u4").astype(np.int64)) + first
        return prefix.of(at, at + length)

    return keys_of


def _spans(length: int, v: int, buckets: int):
    """Maximal runs of covered bytes of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = _merged(length, v)
        for batch in batches:
            data, bounds = flat(batch.column(1))
            places, marks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            removed, spans, digests = [], [], []
            for i in range(len(bounds) - 1):
                own = data[bounds[i]:bounds[i + 1]]
                n = len(own)
                at = remaining(n, length, v, np.frombuffer(places[i], "<u4").astype(np.int64))
                on = at[flagged(keys_of(Prefix(own), 0, n, places[i]), marks[i], buckets)]
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, on, 1)
                np.add.at(edge, on + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"first": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(digests)],
                                             names=["owner", "n_removed", "spans", "kept_sha256"])

    return run


def _apart(keys_of):
    """Each key of a text once: equal ones are then of two texts."""
    return lambda *text: np.unique(keys_of(*text))


def _passages(length: int, v: int, buckets: int):
    """Maximal runs of covered words of each text, as byte runs from the first word's to the last word's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = _merged(length, v)
        for batch in batches:
            data, bounds = flat(batch.column(1))
            places, copies, marks = (batch.column(k).to_pylist() for k in (2, 3, 4))
            covered, spans = [], []
            for i in range(len(bounds) - 1):
                own = WordPrefix(data[bounds[i]:bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
                n = len(own.first)
                if copies[i] > 1:  # has a name, so it has the words
                    turn = np.array([[0, n]])
                else:
                    keys, same = np.unique(keys_of(own, 0, n, places[i]), return_inverse=True)
                    at = remaining(n, length, v, np.frombuffer(places[i], "<u4").astype(np.int64))
                    on = at[flagged(keys, marks[i], buckets)[same]]
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, on, 1)
                    np.add.at(edge, on + length, -1)
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]]).astype(np.int8))).reshape(-1, 2)
                covered.append(int((turn[:, 1] - turn[:, 0]).sum()))
                spans.append([{"first": int(own.first[x]), "end": int(own.end[y - 1])} for x, y in turn])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(covered, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                                             names=["owner", "passage_words", "passages"])

    return run


def _places(rows: DataFrame, copies: DataFrame, length: int, size: float, bucket_bytes: int, units, name: str) -> DataFrame:
    """The first round: (owner, text, places, least, copies), one row of each text that holds a repeated name."""
    v, cover = cover_for(length)
    buckets = int(size * len(cover) / v * 5 // bucket_bytes) + 1
    names = _named(length, v, cover)
    marks = equal_neighbours(rows.select("owner", "text"), names, buckets, 5, f"repeated-names{name}", units)
    texts = rows.withColumn("row", F.xxhash64("doc_id")).join(marks.join(copies, "owner"), ["owner", "row"]).select("owner", "text", "marks", "copies")
    return stored(texts.mapInArrow(_positions(names, length, v, cover, buckets, units), "owner long, text string, places binary, least long, copies long"), f"places{name}")


def _near(places: DataFrame) -> DataFrame:
    """Texts with the same names meet in one batch, and a large group of them in several."""
    return places.repartitionByRange("least", "owner").sortWithinPartitions("least", "owner").select("owner", "text", "places")


def find_repeats(docs: DataFrame, length: int = 400, bucket_bytes: int = BUCKET_BYTES, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte runs to remove), kept_sha256, passage_words and passages (byte runs
    of words that another document has too; nothing is removed for them) of each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("owner"), F.octet_length(text).cast("long").alias("n_bytes"))
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    narrow = base.select("owner", F.xxhash64("doc_id").alias("row"))
    copies = stored(narrow.groupBy("owner").agg(F.count("*").alias("copies"), F.min("row").alias("row")), "copies")
    places = _places(base.where(F.col("n_bytes") >= length), copies, length, total, bucket_bytes, in_bytes, "")
    v, _ = cover_for(length)
    left = places.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(left * 8 // bucket_bytes) + 1
    equal = equal_neighbours(_near(places), _merged(length, v), buckets, 8, "equal-prefixes")
    found = places.join(equal, "owner").select("owner", "text", "places", "marks").mapInArrow(
        _spans(length, v, buckets), "owner long, n_removed long, spans array<struct<first:bigint,end:bigint>>, kept_sha256 string")
    found = stored(found.dropDuplicates(["owner"]), "repeat-spans")
    passages = _find_passages(base, copies, words, total, bucket_bytes)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    plain = base.select("doc_id", "owner", "n_bytes", F.sha2("text", 256).alias("own_sha256"))
    return plain.join(copies.select("owner", "copies"), "owner").join(found, "owner", "left").join(passages, "owner", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, everything).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        F.coalesce("passage_words", F.lit(0)).alias("passage_words"), F.coalesce("passages", none).alias("passages"))


def _find_passages(base: DataFrame, copies: DataFrame, words: int, total: int, bucket_bytes: int) -> DataFrame:
    """(owner, passage_words, passages) of each text with a passage of ``words`` words or more in another document."""
    places = _places(base.where(F.col("n_bytes") >= 2 * words - 1), copies, words, total / WORD_BYTES, bucket_bytes, in_words, "-of-words")
    v, _ = cover_for(words)
    left = places.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(left / WORD_BYTES * 8 // bucket_bytes) + 1
    equal = equal_neighbours(_near(places), _apart(_merged(words, v)), buckets, 8, "equal-words", in_words)
    rows = places.join(equal, "owner", "left").where("copies > 1 OR marks IS NOT NULL").select("owner", "text", "places", "copies", "marks")
    found = rows.mapInArrow(_passages(words, v, buckets), "owner long, passage_words long, passages array<struct<first:bigint,end:bigint>>")
    return stored(found.dropDuplicates(["owner"]), "passages")
