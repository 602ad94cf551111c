"""Token ids as flat binary files with 64-bit document offsets, written and memory-mapped by partition.

Pass one range-partitions documents by key, encodes them and appends the ids of each partition to one flat
little-endian file (16-bit where the vocabulary allows, else 32-bit), with the partition's own document starts and keys
beside it. Prefix sums over the partition sizes give each partition its base; pass two adds the base to
the starts. A folder then holds, for each partition listed in its ``manifest`` (a Parquet table, one row per partition),

* ``*.ids``       unsigned ids, documents one after another,
* ``*.offsets``   n_docs + 1 unsigned 64-bit places in the stream of all ids of the folder,
* ``*.keys``      n_docs signed 64-bit keys, the first ``n_null`` of which stand for null.

A task writes files under a name of its own attempt and only names that its row in the manifest tells are read, so
a lost executor or a second attempt leaves at most files that nothing refers to. Batches are appended as they
come: no task holds a partition.

Where the tokenizer's file says that it drops white space and works piece by piece, words are cut by the file's own
pattern and each distinct piece is given to its model once per task; words with unusual characters, texts with
special strings, and all texts of any other tokenizer, go to the library whole.

Defined cases: a null text is an empty one, of which the end id remains. Null keys come first. Rows of equal key are ordered by
a hash of their text and else as they were read; they may lie in several partitions. Of a text of any length one
row is held, and ids are made from runs of about ``RUN`` bytes. An empty table gives a folder without partitions. Other columns are not used.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.session import scratch

from .bytetext import runs

RUN = 4 << 20
PART_BYTES = 64 << 20
READ_IDS = 1 << 20
PIECES_HELD = 400_000
#: Characters that every Unicode version classes and lower-cases alike, none of which joins with its neighbour.
PLAIN = "[\n\x21-\x7e¡-¬®-\u012f\u0131-ſ–—‘-”…€]*"
#: Partitions whose sizes are summed up together.
SUMMED = 1024
PART_DDL = "part int, name string, n_docs long, n_null long, n_ids long"
MANIFEST_DDL = PART_DDL + ", first_doc long, first_id long, id_bytes int"


def word_rule(path: str) -> tuple[str, bool] | None:
    """The pattern by which a tokenizer file cuts text into pieces and whether it lower-cases first, where it drops
    white space and looks at pieces one by one as bytes; None for any other file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"], s.get("pattern"), s.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for s in steps)
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, then = before[0], before[1:]
    pattern = first.get("pattern", {}).get("Regex", "")
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    by_bytes = [(t["type"], t.get("use_regex"), t.get("add_prefix_space")) for t in then] == [("ByteLevel", False, False)]
    spaces = re.search(r"[ .]|\\s", pattern.replace(r"[^\s", "["))
    return (pattern, any(s["type"] == "Lowercase" for s in steps)) if plain and split and by_bytes and pattern and not spaces else None


class WordIds:
    """Ids of distinct words. Words are cut by the file's own pattern and each distinct piece is given to the
    tokenizer's model once; words with unusual characters go to the library whole."""

    def __init__(self, tokenizer, rule: tuple[str, bool]):
        import regex

        self.tokenizer, self.lower = tokenizer, rule[1]
        self.cut, self.plain = regex.compile(f"{rule[0]}|\n"), regex.compile(PLAIN)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.place, self.ids, self.ends = {}, array("I"), array("q", [0])

    def _hold(self, piece: str, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.place[piece] = at = len(self.ends) - 2
        return at

    def _missing(self, piece: str) -> int:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._hold(piece, [t.id for t in self.tokenizer.model.tokenize(letters)])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the word bounds in them. No word holds a line end."""
        if len(self.place) > PIECES_HELD:
            self.forget()
        text, odd = "\n".join(words.to_pylist()), {}
        if not self.plain.fullmatch(text):
            listed = text.split("\n")
            odd = {i: w for i, w in enumerate(listed) if not self.plain.fullmatch(w)}
            text = "\n".join("" if i in odd else w for i, w in enumerate(listed))
        held = self.place
        held["\n"] = -1
        found = self.cut.findall(text.lower() if self.lower else text)
        places = np.array([self._missing(p) if (at := held.get(p)) is None else at for p in found], np.int64)
        line_ends = np.flatnonzero(places < 0)
        pool, edges = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        sizes = np.where(places < 0, 0, edges[places + 1] - edges[places])
        ids, ends = gathered(pool, np.where(places < 0, 0, edges[places]), sizes)
        bounds = np.concatenate([[0], ends[line_ends], [len(ids)]]) if len(words) else np.zeros(1, np.int64)
        if not odd:
            return ids, bounds
        own = dict(zip(odd, self.tokenizer.encode_batch_fast(list(odd.values()), add_special_tokens=False)))
        return _joined([np.array(own[i].ids, np.uint32) if i in own else ids[bounds[i]:bounds[i + 1]] for i in range(len(words))])


def gathered(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool`` one after another, and their bounds."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return (pool[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])] if ends[-1] else pool[:0].copy()), ends


class Encoder:
    """Ids of many texts at once, without special tokens of the template."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rule = word_rule(path)
        self.words = WordIds(self.tokenizer, rule) if rule and not any(re.search(r"\s", t) for t in self.specials) else None

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column without nulls, and the row bounds in them."""
        if not self.words:
            return _joined(self._library(column.to_pylist()))
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        special = np.zeros(len(column), bool)
        for s in self.specials:
            if pc.any(pc.match_substring(words.dictionary, s)).as_py():
                special |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        pool, edges = self.words.of(words.dictionary)
        place = words.indices.to_numpy()
        ids, ends = gathered(pool, edges[place], np.diff(edges)[place])
        bounds = split.offsets.to_numpy().astype(np.int64)
        row_ends = ends[bounds - bounds[0]]
        if not special.any():
            return ids, row_ends
        own = dict(zip(np.flatnonzero(special).tolist(), self._library(column.filter(pa.array(special)).to_pylist())))
        return _joined([own[i] if i in own else ids[row_ends[i]:row_ends[i + 1]] for i in range(len(column))])


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), bounds


def id_bytes(path: str, end_id: int) -> int:
    """Width of an id in the files."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return 2 if most < 1 << 16 else 4


def _write(path: str, end_id: int, width: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}"
        encoder, out, docs, nulls, total = None, [], 0, 0, 0
        for batch in batches:
            if not out:
                encoder = Encoder(path)
                out = [files.open_output_stream(f"{root}/{name}.{kind}") for kind in ("ids", "starts", "keys")]
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
            for a, b in runs(sizes, RUN):
                ids, bounds = encoder.encode(texts.slice(a, b - a))
                spread = np.full(len(ids) + b - a, end_id, f"<u{width}")
                spread[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(bounds))] = ids
                out[0].write(spread.tobytes())
                out[1].write((total + bounds[:-1] + np.arange(b - a)).astype("<u8").tobytes())
                total += len(spread)
            keys = batch.column(0)
            out[2].write(keys.fill_null(0).to_numpy().astype("<i8").tobytes())
            docs, nulls = docs + len(keys), nulls + keys.null_count
        for f in out:
            f.close()
        if out:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": docs, "n_null": nulls, "n_ids": total}],
                                             pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]))

    return run


def with_bases(parts: DataFrame) -> DataFrame:
    """Partition sizes with first_doc and first_id, the sums over all partitions before: sums of groups of partitions
    first, then running sums within each group."""
    sums = {"first_doc": "n_docs", "first_id": "n_ids"}
    grouped = parts.withColumn("group", F.floor(F.col("part") / SUMMED))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(*[F.sum(n).alias(n) for n in sums.values()])
    groups = groups.select("group", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{first}_group") for first, n in sums.items()])
    within = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(groups, "group").select(*parts.columns, *[
        (F.col(f"{first}_group") + F.coalesce(F.sum(n).over(within), F.lit(0))).cast("long").alias(first) for first, n in sums.items()])


def _rebase(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                stem = f"{root}/{row['name']}"
                again = f"{row['name']}-{uuid.uuid4().hex}"
                with files.open_input_file(f"{stem}.starts") as starts, files.open_output_stream(f"{root}/{again}.offsets") as out:
                    while chunk := starts.read(8 * READ_IDS):
                        out.write((np.frombuffer(chunk, "<u8") + np.uint64(row["first_id"])).astype("<u8").tobytes())
                    out.write(np.array([row["first_id"] + row["n_ids"]], "<u8").tobytes())
                row["offsets"] = f"{again}.offsets"
            yield pa.RecordBatch.from_pylist(rows, batch.schema.append(pa.field("offsets", pa.string())))

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None, key: str = "doc_id", part_bytes: int = PART_BYTES) -> str:
    """Ids of all texts of ``docs`` in ascending order of the integer column ``key``, each document closed by ``end_id``; returns the folder."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("key"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, int(total // part_bytes) + 1)
    order = ["key", "tie", "row"]
    ranged = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    width = id_bytes(path, end_id)
    parts = f"{folder}/parts"
    ranged.select("key", "text").mapInArrow(_write(path, end_id, width, folder), PART_DDL).write.parquet(parts)
    based = with_bases(spark.read.schema(PART_DDL).parquet(parts)).withColumn("id_bytes", F.lit(width))
    based = based.repartitionByRange(n, "part").mapInArrow(_rebase(folder), MANIFEST_DDL + ", offsets string")
    based.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per partition of a folder."""
    return spark.read.schema(MANIFEST_DDL + ", offsets string").parquet(f"{folder}/manifest")


def _mapped(files: pa.fs.FileSystem, path: str) -> pa.NativeFile:
    """A file to read at any place: memory-mapped where it is local."""
    return pa.memory_map(path) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(path)


def _array(file: pa.NativeFile, kind: str, first: int, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    file.seek(width * first)
    return np.frombuffer(file.read_buffer(width * n), kind, n)


def _documents(folder: str, with_ids: bool):
    fields = [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            stem, kind = f"{root}/{row['name']}", f"<u{row['id_bytes']}"
            with _mapped(files, f"{stem}.ids") as ids, _mapped(files, f"{root}/{row['offsets']}") as offsets, _mapped(files, f"{stem}.keys") as keys:
                at = 0
                while at < row["n_docs"]:
                    bounds = _array(offsets, "<u8", at, min(row["n_docs"] - at, 1 << 16) + 1).astype(np.int64)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")) - 1)
                    bounds = bounds[:n + 1]
                    own = _array(ids, kind, int(bounds[0]) - row["first_id"], int(bounds[-1] - bounds[0])).astype("<u4")
                    cut = bounds - bounds[0]
                    names = pa.array(_array(keys, "<i8", at, n), pa.int64(), mask=np.arange(at, at + n) < row["n_null"])
                    crcs = [zlib.crc32(own[cut[i]:cut[i + 1]]) for i in range(n)]
                    columns = [names, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(own.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                    at += n

    return run


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and, if asked for, ids of each document of a folder, read from its files."""
    parts = manifest(spark, folder)
    ddl = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return parts.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "part").mapInArrow(_documents(folder, with_ids), ddl)


class TokenStream:
    """All ids of a folder as one stream, memory-mapped: ids by place, documents by number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.root = pa.fs.FileSystem.from_uri(folder)
        self.parts = [r.asDict() for r in manifest(spark, folder).orderBy("part").collect()]  # one row per file
        self.first_ids = [p["first_id"] for p in self.parts]
        self.first_docs = [p["first_doc"] for p in self.parts]

    def __len__(self) -> int:
        return self.parts[-1]["first_id"] + self.parts[-1]["n_ids"] if self.parts else 0

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids [start, start + n) of the stream, across partitions."""
        out, end = [], min(start + n, len(self))
        while start < end:
            part = self.parts[int(np.searchsorted(self.first_ids, start, "right")) - 1]
            take = min(end, part["first_id"] + part["n_ids"]) - start
            with _mapped(self.files, f"{self.root}/{part['name']}.ids") as file:
                out.append(_array(file, f"<u{part['id_bytes']}", start - part["first_id"], take).astype(np.uint32))
            start += take
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        """Ids of the document of this number in key order, its end id included."""
        part = self.parts[int(np.searchsorted(self.first_docs, number, "right")) - 1]
        with _mapped(self.files, f"{self.root}/{part['offsets']}") as file:
            start, end = _array(file, "<u8", number - part["first_doc"], 2).tolist()
        return self.ids(start, end - start)
