"""Sharding by a two-pass external shuffle.

Pass one scatters rows by seeded hashes: the shard by highest random weight of (doc_id, shard),
so one more shard takes rows only into itself, and a bucket within the shard uniformly, with so
many buckets that one fits a task's memory. Pass two puts each bucket into a fixed order, applies a
seeded Fisher-Yates shuffle and writes it. Slots are bucket offsets plus the place in the bucket, so
no task ever sees more than one bucket.

Defined cases: rows with a null doc_id share a shard, but not a bucket; a null text has size 1. Equal rows
are all written and interchangeable. An empty table gives no rows. Columns of the input that
clash with the names added here are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import scratch

BUCKET_BYTES = 32 << 20


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Shard with the highest hash of (key, shard)."""
    drawn = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*drawn) if shards > 1 else drawn[0])["s"]


def _shuffle_bucket(seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, bucket = (k.as_py() for k in key)
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("order", "ascending"), ("content", "ascending")]))
        place = np.arange(len(rows))
        np.random.default_rng([seed, shard, bucket]).shuffle(place)  # a Fisher-Yates shuffle
        return rows.drop_columns(["order", "content"]).take(pa.array(place)).append_column("place", pa.array(np.arange(len(rows))))

    import pyarrow.compute  # noqa: F401
    return run


def external_shuffle(docs: DataFrame, shards: int, seed: int = 11, folder: str | None = None,
                     bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The written rows (with shard, bucket, place; a folder for each shard) and the bucket
    offsets (shard, bucket, n, first); a row's slot is first + place."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "bucket", "place", "order", "content")
    keyed = docs.withColumns({"shard": shard_of(F.col("doc_id"), shards, seed), "content": F.xxhash64("text"),
                              "order": F.xxhash64("doc_id", "text", F.lit(seed))})
    largest = keyed.groupBy("shard").agg(F.sum(size_of(F.col("text"))).alias("b")).agg(F.max("b")).first()[0]
    buckets = max(1, -(-(largest or 0) // bucket_bytes))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(seed + 1)), F.lit(buckets)).cast("int"))
    folder = folder or scratch(spark, "shards")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.drop("order", "content").schema)
    shuffled = keyed.groupBy("shard", "bucket").applyInArrow(_shuffle_bucket(seed), f"{fields}, place long")
    shuffled.write.partitionBy("shard").parquet(folder)
    written = spark.read.schema(shuffled.schema).parquet(folder)
    offsets = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return written, offsets.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long"))


def slots(written: DataFrame, offsets: DataFrame) -> DataFrame:
    """``written`` with its gapless ``slot``. The offsets, one short row for each ``bucket_bytes`` of
    texts, are broadcast: a shuffle would write all texts to disk once more."""
    return written.join(F.broadcast(offsets.select("shard", "bucket", "first")), ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("place")).drop("first")
