"""Token counts through a digest cache.

Counts are stored under (digest of the content, digest of the tokenizer file). A run joins the
digests of its texts to the cache, encodes one text per missing digest, appends the counts as
new files and joins again. Encoding splits a text by the vocabulary's own pre-token rule and
counts each distinct piece once per worker, with the tokenizer library; texts with characters
whose class depends on the Unicode version, and texts with special strings, go to the library whole.

Defined cases: a null text is an empty one (0 bytes, 0 tokens). Repeated texts are encoded once.
Rows with a null or repeated doc_id are counted like any other. A run that is lost before its append
leaves the cache as it was; counts appended twice are equal and read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.session import scratch

#: The pre-token rule of the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version classes alike.
PLAIN = "[\t\n\r\x20-\x7e¡-¬®-ſ–—‘-”…€]*"
PIECES_HELD = 400_000


class PieceCounts(dict):
    """Tokens of each pre-token, asked of the library once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) >= PIECES_HELD:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


def counter(path: str):
    """A function from text to its number of tokens."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pieces, plain, counts = regex.compile(PIECES), regex.compile(PLAIN), PieceCounts(tokenizer)

    def count(text: str) -> int:
        if plain.fullmatch(text) and not any(s in text for s in specials):
            return sum(map(counts.__getitem__, pieces.findall(text)))
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    return count


def file_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version; None where nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    rows = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit, through the cache folder ``cache``.

    A column of ``docs`` with one of these names, or named digest, is replaced.
    """
    spark, version = docs.sparkSession, file_digest(path)
    cache = cache or scratch(spark, "token-cache")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("n_bytes", "n_tokens", "over_limit", "digest")
    keyed = docs.withColumns({"digest": F.unhex(F.sha2(text, 256)), "n_bytes": F.octet_length(text).cast("long")})
    # one row of each digest, found without moving a text
    row = docs.withColumn("digest", F.unhex(F.sha2(text, 256))).select("digest", F.xxhash64("doc_id").alias("row"), text.alias("text"))
    firsts = row.groupBy("digest").agg(F.min("row").alias("row"))
    known = read_cache(spark, cache, version)
    if known is not None:
        firsts = firsts.join(known, "digest", "left_anti")
    misses = row.join(firsts, ["row", "digest"], "left_semi")
    encode_misses(misses, path).withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    return (keyed.join(counts, "digest").drop("digest")
            .withColumn("over_limit", F.col("n_tokens") > limit))
