"""Cross-tokenizer alignment by white-space anchors.

Both tokenizers encode each whole text. Every token's bytes give its place in the text; a document whose joined
bytes differ from a space and its text, under either tokenizer, has no tokens. Anchors are the places where both have a token
that starts with a space: what precedes ends there in both (checked on byte places, not assumed). Anchors
cut a document into windows of token ids, mostly words. A window's alignment depends on its ids alone, so
it is worked out once per block of documents for each tuple of ids (found by hash, compared id by id): its groups (the cuts at
which tokens of both end) and its links (token pairs whose bytes overlap; each is one cell between neighbouring token ends).

Corpus-wide counts come from blocks of documents: a block lists its distinct links with their
counts, Spark adds these up, finds each B id's highest, and brings back to every block what its links need. So
the shuffles carry distinct links per block, not links per document, and the most common link is one row a block.

Defined cases: a null or empty text has no tokens: zeros and an empty group text. A text that a tokenizer does not
give back byte for byte (U+2581 for instance) likewise. Rows with null or equal keys, and copies, each count. A text of any length is in one block,
alone where it is longer than ``BLOCK_BYTES``; a text without spaces is one window. An empty table gives no rows. Columns beside the key and the text are not used.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U, mixed, runs
from .tables import stored

BLOCK_BYTES = 3 << 19
#: Texts a library gets at a time.
AT_ONCE = 64
#: The cutting pattern of byte-level vocabularies. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version classes alike.
PLAIN = "[\t\n\r\x20-\x7e¡-¬®-ſ–—‘-”…€]*"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, all others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def in_merge_order(spec: dict) -> bool:
    """Whether a byte-level tokenizer file has no normalizer, cuts by the usual pattern and numbers its merges in order, after
    the single bytes: then ids are ranks, and an encoder of ranks gives the same ids."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return (not spec.get("normalizer") and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not model.get("dropout") and not model.get("ignore_merges") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
            and all(model["vocab"]["".join(m)] == 256 + k for k, m in enumerate(pairs)))


class Tokens:
    """A tokenizer with the bytes of each of its ids. A ``.json`` file is a byte-level one, given a space before the
    text; a ``.model`` file adds that space itself. Texts of usual characters go through the faster rank encoder, built from the
    same file, where ``in_merge_order`` holds; all others through the file's own library."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = {i: model.id_to_piece(i) for i in range(model.vocab_size())}
            self.bytes_of = {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()}
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import regex
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_padding()
            self.library.no_truncation()
            self.library.encode_special_tokens = True
            letters = byte_letters()
            self.bytes_of = {i: bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p, i in self.library.get_vocab().items()}
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.ranks, self.plain = None, regex.compile(PLAIN)
            if in_merge_order(spec):
                import tiktoken

                ranks = {self.bytes_of[i]: i for i in spec["model"]["vocab"].values()}
                self.ranks = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = self._encode
        most = max(self.bytes_of) + 1
        self.sizes = np.zeros(most, np.int64)
        self.spaced = np.zeros(most, bool)
        for i, b in self.bytes_of.items():
            self.sizes[i], self.spaced[i] = len(b), b[:1] == b" "
        self.names = [str(i) for i in range(most)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        usual = [self.ranks is not None and self.plain.fullmatch(t) is not None for t in texts]
        rest = iter(self.library.encode_batch_fast([" " + t for t, u in zip(texts, usual) if not u], add_special_tokens=False))
        return [self.ranks.encode_ordinary(" " + t) if u else next(rest).ids for t, u in zip(texts, usual)]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Stream:
    """Ids of several texts under one tokenizer, one after another, with the places of their bytes."""

    def __init__(self, tokens: Tokens, rows: list[np.ndarray]):
        self.bounds = np.cumsum([0, *map(len, rows)])
        self.ids = np.concatenate(rows).astype(np.int64)
        sizes = tokens.sizes[self.ids]
        self.ends = np.cumsum(sizes)
        marked = np.flatnonzero(tokens.spaced[self.ids])
        self.marked, self.marked_at = marked, self.ends[marked] - sizes[marked]

    def cut(self, at: np.ndarray) -> None:
        """Windows begin at these tokens."""
        self.first, self.sizes = at, np.diff(np.append(at, len(self.ids)))

    def hashes(self, salt: int) -> np.ndarray:
        """A hash of each window's ids in order."""
        place = np.arange(len(self.ids)) - np.repeat(self.first, self.sizes)
        return np.add.reduceat(mixed(self.ids.astype(U) + mixed(place.astype(U) + U(salt))), self.first)

    def of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of these windows, and their bounds."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[windows])])
        return np.repeat(self.first[windows] - ends[:-1], self.sizes[windows]) + np.arange(ends[-1]), ends


class Windows:
    """Whole texts cut into windows. ``bounds`` are the texts' bounds in ``place``, the number of each window among the
    distinct ones; of these, the group texts, the numbers of groups and the links (``a << 32 | b``) with bounds are kept."""

    def __init__(self, a: Tokens, b: Tokens, texts: list[str]):
        rows_a, rows_b = [], []
        for k in range(0, len(texts), AT_ONCE):
            some = texts[k:k + AT_ONCE]
            for text, ids_a, ids_b in zip(some, a.encode(some), b.encode(some)):
                raw = (" " + text).encode() if text else None
                same = raw is not None and a.joined(ids_a) == raw and b.joined(ids_b) == raw
                rows_a.append(np.array(ids_a if same else [], np.int32)), rows_b.append(np.array(ids_b if same else [], np.int32))
        one, two = Stream(a, rows_a), Stream(b, rows_b)
        self.n_a, self.n_b = np.diff(one.bounds), np.diff(two.bounds)
        _, at_a, at_b = np.intersect1d(one.marked_at, two.marked_at, assume_unique=True, return_indices=True)
        one.cut(one.marked[at_a]), two.cut(two.marked[at_b])  # each text that has tokens starts with one
        self.bounds = np.searchsorted(one.first, one.bounds)
        if not len(one.first):
            self.place, self.groups, self.group_texts = np.zeros(0, np.int64), np.zeros(0, np.int64), []
            self.links, self.link_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        chosen, self.place = self._distinct(one, two)
        self._align(a, b, one, two, chosen)

    @staticmethod
    def _distinct(one: Stream, two: Stream) -> tuple[np.ndarray, np.ndarray]:
        """A window of each tuple of ids, and which of them each window equals, ids compared."""
        for salt in itertools.count(1):
            key = mixed(one.hashes(salt) + mixed(two.hashes(-salt % 2**32)))
            _, chosen, place = np.unique(key, return_index=True, return_inverse=True)
            like, same = chosen[place], True
            for s in (one, two):
                same = same and np.array_equal(s.sizes[like], s.sizes) and np.array_equal(s.ids[s.of(like)[0]], s.ids)
            if same:
                return chosen, place

    def _align(self, a: Tokens, b: Tokens, one: Stream, two: Stream, chosen: np.ndarray) -> None:
        """Links and groups of the chosen windows, laid one after another."""
        at_a, bounds_a = one.of(chosen)
        at_b, bounds_b = two.of(chosen)
        ids_a, ids_b = one.ids[at_a], two.ids[at_b]
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        cells = np.union1d(ends_a, ends_b)  # each cell between neighbouring ends is one link
        last = ends_a[bounds_a[1:] - 1]
        in_a, in_b = np.searchsorted(ends_a, cells), np.searchsorted(ends_b, cells)
        self.links = ids_a[in_a] << 32 | ids_b[in_b]
        self.link_bounds = np.concatenate([[0], np.searchsorted(cells, last, "right")])
        both = np.flatnonzero((ends_a[in_a] == cells) & (ends_b[in_b] == cells))  # cells that close a group
        group_bounds = np.searchsorted(cells[both], last, "right")
        self.groups = np.diff(np.concatenate([[0], group_bounds]))
        names_a, names_b = [a.names[i] for i in ids_a.tolist()], [b.names[i] for i in ids_b.tolist()]
        texts, p, q = [], 0, 0
        for x, y in zip((in_a[both] + 1).tolist(), (in_b[both] + 1).tolist()):
            texts.append((names_a[p] if x == p + 1 else ",".join(names_a[p:x])) + "|" + (names_b[q] if y == q + 1 else ",".join(names_b[q:y])))
            p, q = x, y
        first = [0, *group_bounds.tolist()]
        self.group_texts = [texts[i] if j == i + 1 else ";".join(texts[i:j]) for i, j in zip(first, first[1:])]

    def text(self, k: int) -> str:
        """All groups of text k."""
        return ";".join([self.group_texts[i] for i in self.place[self.bounds[k]:self.bounds[k + 1]].tolist()])


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b and groups (a text such as ``a1,a2|b1;a3|b2,b3``) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Tokens(path_a), Tokens(path_b)
        for keys, texts in bounded(batches, BLOCK_BYTES):
            windows = Windows(a, b, texts)
            groups = pa.array([windows.text(k) for k in range(len(texts))], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(windows.n_a), pa.array(windows.n_b), groups], names=["key", "n_a", "n_b", "groups"])

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(run, "key long, n_a long, n_b long, groups string")


def bounded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts in runs of about ``most`` bytes, within batches."""
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        for a, b in runs(bounds, most):
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a).to_pylist()


def packed_block(number: int, keys: pa.Array, windows: Windows) -> pa.RecordBatch:
    """One row: the documents of a block, its distinct windows and its distinct links."""
    of_window = np.diff(windows.link_bounds)
    own, times, digests = [], [], []
    for k in range(len(keys)):
        w, t = np.unique(windows.place[windows.bounds[k]:windows.bounds[k + 1]], return_counts=True)
        own.append(np.diff(w, prepend=0).astype("<u4").tobytes()), times.append(t.astype("<u4").tobytes())
        digests.append(hashlib.sha256(windows.text(k).encode()).hexdigest() if len(w) else "")
    sums = [np.concatenate([[0], np.cumsum(v[windows.place])]) for v in (windows.groups, of_window)]
    n_groups, n_links = (np.diff(v[windows.bounds]) for v in sums)
    distinct, place = np.unique(windows.links, return_inverse=True)
    weight = np.repeat(np.bincount(windows.place, minlength=len(of_window)), of_window).astype(np.float64)
    counts = np.bincount(place, weight, len(distinct)).astype(np.int64)
    one = {"block": number, "keys": keys.to_pylist(), "n_a": windows.n_a, "n_b": windows.n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "windows": own, "times": times,
           "window_sizes": of_window.astype("<u4").tobytes(), "window_links": place.astype("<u4").tobytes(),
           "link_a": (distinct >> 32).astype(np.int32), "link_b": (distinct & 0xFFFFFFFF).astype(np.int32), "link_n": counts}
    return pa.RecordBatch.from_pylist([one], BLOCK)


_LONGS = pa.list_(pa.int64())
BLOCK = pa.schema([("block", pa.int64()), ("keys", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS), ("groups_sha256", pa.list_(pa.string())),
                   ("windows", pa.list_(pa.binary())), ("times", pa.list_(pa.binary())), ("window_sizes", pa.binary()), ("window_links", pa.binary()),
                   ("link_a", pa.list_(pa.int32())), ("link_b", pa.list_(pa.int32())), ("link_n", _LONGS)])
BLOCK_DDL = ("block long, keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, windows array<binary>, "
             "times array<binary>, window_sizes binary, window_links binary, link_a array<int>, link_b array<int>, link_n array<long>")


def blocks_of(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, number = Tokens(path_a), Tokens(path_b), TaskContext.get().partitionId() << 32
        for keys, texts in bounded(batches, block_bytes):
            yield packed_block(number, keys, Windows(a, b, texts))
            number += 1

    return stored(docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(run, BLOCK_DDL), "aligned-blocks")


def block_links(blocks: DataFrame) -> DataFrame:
    """(block, place, a_id, b_id, n) of each block's distinct links."""
    zipped = F.arrays_zip(F.col("link_a").alias("a_id"), F.col("link_b").alias("b_id"), F.col("link_n").alias("n"))
    return blocks.select("block", F.posexplode(zipped).alias("place", "link")).select("block", "place", "link.a_id", "link.b_id", "link.n")


def link_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, count over all blocks, and whether it is the highest of its b_id: how the two vocabularies translate."""
    counts = stored(block_links(blocks).groupBy("a_id", "b_id").agg(F.sum("n").alias("count")), "link-counts")
    best = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    return counts.join(best, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block with the sums over their links."""
    for row in (r for batch in batches for r in batch.to_pylist()):
        sizes = np.frombuffer(row["window_sizes"], "<u4").astype(np.int64)
        links = np.frombuffer(row["window_links"], "<u4")
        stats = row["stats"] or []
        count, best = np.zeros(len(stats), np.int64), np.zeros(len(stats), np.int64)
        at = np.array([s["place"] for s in stats], np.int64)
        count[at], best[at] = [s["count"] for s in stats], [s["best"] for s in stats]
        starts = np.cumsum(sizes) - sizes
        of_window = [np.add.reduceat(v[links], starts) if len(starts) else v for v in (count, best)]
        sums = []
        for windows, times in zip(row["windows"], row["times"]):
            w, t = np.cumsum(np.frombuffer(windows, "<u4")), np.frombuffer(times, "<u4").astype(np.int64)  # steps to the places
            sums.append([int((v[w] * t).sum()) for v in of_window])
        longs = [pa.array(row[c], pa.int64()) for c in ("keys", "n_a", "n_b", "n_groups", "n_links")]
        yield pa.RecordBatch.from_arrays([*longs, pa.array([s[1] for s in sums], pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array(row["groups_sha256"], pa.string())],
                                         names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def score_documents(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    stats = block_links(blocks).join(counts, ["a_id", "b_id"]).groupBy("block").agg(F.collect_list(F.struct("place", "count", F.col("best").cast("long").alias("best"))).alias("stats"))
    rows = blocks.drop("link_a", "link_b", "link_n").join(stats, "block", "left")
    return rows.mapInArrow(_scored, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
