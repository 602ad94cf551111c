"""Parquet recordings: read, check, list, combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetpulse.functions.percentiles import percentiles_or_null
from fleetpulse.functions.text import decode_buckets, decode_labels, encode_labels
from fleetpulse.schema import KINDS, RECORDING, ROLLUP_COLUMNS, U64, U64_MAX, bucket_array_type, u64

# Epoch milliseconds of the years 0000 and 9999.
TS_MS_RANGE = (-62167219200000, 253402300799999)
INDEX = "path string, uri string, bytes bigint, modified timestamp, rows bigint, first_ms bigint, last_ms bigint"


def _reasons(df: DataFrame):
    buckets, labels = F.col("__buckets"), F.col("__labels")
    nulls = None
    for name in RECORDING.fieldNames():
        nulls = F.col(name).isNull() if nulls is None else nulls | F.col(name).isNull()
    unordered = F.when(F.size(buckets) > 1, F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(buckets) - 1, F.lit(1))),
        lambda i: F.element_at(buckets, i)["bound"] >= F.element_at(buckets, i + 1)["bound"])).otherwise(F.lit(False))
    total = F.aggregate(buckets, F.lit(0).cast("decimal(38,0)"),
                        lambda a, b: (a + b["count"]).cast("decimal(38,0)"))
    return (F.when(nulls, F.lit("null value"))
            .when(~F.col("ts_unix_ms").between(*TS_MS_RANGE), F.lit("timestamp out of range"))
            .when(~F.col("kind").isin(*KINDS), F.lit("unknown kind"))
            .when(labels.isNull(), F.lit("malformed labels"))
            .when(buckets.isNull(), F.lit("malformed buckets"))
            .when(F.exists(buckets, lambda b: (b["bound"] < 0) | (b["count"] < 0)
                           | (b["bound"] > u64(U64_MAX)) | (b["count"] > u64(U64_MAX))), F.lit("malformed buckets"))
            .when(unordered, F.lit("bounds not increasing"))
            .when(total > F.lit(str(U64_MAX)).cast("decimal(38,0)"), F.lit("count overflow")))


def _checked(df: DataFrame) -> DataFrame:
    parsed = df.withColumns({"__labels": decode_labels("labels_json"), "__buckets": decode_buckets("buckets_json")})
    return parsed.withColumn("reason", _reasons(parsed))


def validate_recording(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``reason``); ``strict`` fails on the first bad row."""
    checked = _checked(df)
    if strict:
        failed = F.raise_error(F.concat(F.lit("invalid recording: "), F.col("reason")))
        good = checked.where(F.when(F.col("reason").isNotNull(), failed.cast("boolean")).otherwise(F.lit(True)))
    else:
        good = checked.where(F.col("reason").isNull())
    return good.select(*df.columns), checked.where(F.col("reason").isNotNull()).select(*df.columns, "reason")


def decode_recording(df: DataFrame) -> DataFrame:
    """Parsed labels, buckets and percentiles; null percentiles where a histogram is missing."""
    labels, buckets = decode_labels("labels_json"), decode_buckets("buckets_json")
    out = df.select(
        F.timestamp_millis("ts_unix_ms").alias("ts"), "ts_unix_ms", "name", labels.alias("labels"),
        encode_labels(labels).alias("labels_key"), "kind", "unit", F.col("raw").cast(U64).alias("raw"),
        buckets.cast(bucket_array_type(U64)).alias("buckets"))
    out = out.withColumn("__pct", percentiles_or_null("buckets"))
    return out.select("*", *[F.col("__pct")[i].alias(n) for i, n in enumerate(ROLLUP_COLUMNS)]).drop("__pct")


def _scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    reader = spark.read.schema(RECORDING).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return reader.parquet(*paths)


def read_recording(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Decoded rows of a recording; invalid ones are dropped, or fail the query if ``strict``."""
    good, _ = validate_recording(_scan(spark, [path]), strict)
    return decode_recording(good)


def recording_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Complete recordings under ``path``: name, size, rows and time range, newest name first."""
    meta = F.col("_metadata")
    return (_scan(spark, [path])
            .select(meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_size"].alias("bytes"),
                    "ts_unix_ms")
            .groupBy("path", "file", "bytes")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("ts_unix_ms").alias("first_ms"), F.max("ts_unix_ms").alias("last_ms"))
            .orderBy(F.desc("file"), "path"))


def distinct_observations(df: DataFrame) -> DataFrame:
    """Exact duplicates counted once. Grouping on scalars combines map-side, so
    a large group of copies shrinks before it is shuffled."""
    scalars = [c for c in df.columns if c not in ("labels", "tags", "buckets", "labels_key")]
    with_key = df if "labels_key" in df.columns else df.withColumn("labels_key", encode_labels("labels"))
    if "buckets" in df.columns:
        scalars.append("buckets")
    out = with_key.select(*scalars, "labels_key").distinct()
    return out.withColumn("labels", decode_labels("labels_key")) if "labels" in df.columns else out


def load_session(spark: SparkSession, paths: Sequence[str], ordered: bool = False, strict: bool = False,
                 start=None, end=None, index: str | None = None) -> DataFrame:
    """Many recordings as one set of observations. Sort only if a reader needs it.

    ``start`` and ``end`` (anything that casts to a timestamp, both included) keep a time range; ``strict`` then judges
    that range, and rows without time lie in none. With an ``index`` (see :func:`index_recordings`) files that hold
    no row of the range are not opened; files the index does not know, or knows with another size or age, are.
    """
    lo, hi = [None if t is None else F.unix_millis(F.lit(t).cast("timestamp")) for t in (start, end)]
    # A start between two milliseconds excludes the earlier one.
    lo = None if lo is None else F.when(F.timestamp_millis(lo) < F.lit(start).cast("timestamp"), lo + 1).otherwise(lo)
    if index is not None:
        known = _indexed(spark, index).dropDuplicates(["uri", "bytes", "modified"])
        files = _listed(spark, paths).join(known.drop("path"), ["uri", "bytes", "modified"], "left")
        if lo is not None:
            files = files.where(F.col("last_ms").isNull() | (F.col("last_ms") >= lo))
        if hi is not None:
            files = files.where(F.col("first_ms").isNull() | (F.col("first_ms") <= hi))
        # File names only: what Spark's own scan of them keeps on the driver.
        paths = _literal_paths(files)
    rows = _scan(spark, list(paths)) if paths else spark.createDataFrame([], RECORDING)
    if lo is not None:
        rows = rows.where(F.col("ts_unix_ms") >= lo)
    if hi is not None:
        rows = rows.where(F.col("ts_unix_ms") <= hi)
    good, _ = validate_recording(rows, strict)
    # Duplicates go before decoding: four text columns compare cheaper than arrays.
    rows = decode_recording(good.distinct())
    return rows.orderBy("ts", "name", "labels_key") if ordered else rows


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files of recordings, from a listing: none is opened."""
    meta = F.col("_metadata")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(list(paths)))
    return files.select("path", meta["file_path"].alias("uri"), meta["file_size"].alias("bytes"),
                        meta["file_modification_time"].alias("modified"))


def _indexed(spark: SparkSession, index: str) -> DataFrame:
    try:
        return spark.read.schema(INDEX).parquet(index)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def _literal_paths(files: DataFrame) -> list[str]:
    """Paths as the reader takes them, which would read brackets and stars as patterns."""
    escaped = F.regexp_replace("path", r"([\\\[\]{}*?,])", r"\\$1")
    return [r.path for r in files.select(escaped.alias("path")).distinct().collect()]


def index_recordings(spark: SparkSession, paths: Sequence[str], index: str) -> None:
    """Append rows and time range of every file under ``paths`` to the table ``index``, for :func:`load_session`.

    Files the index already holds at their size and age are not read again, so that a growing recording costs its new
    files only. Readers compare with a fresh listing: a missing or stale entry costs time, never rows. A file
    without valid times gets no range and is always read.
    """
    keys = ["uri", "bytes", "modified"]
    new = _listed(spark, paths).join(_indexed(spark, index), keys, "left_anti")
    names = _literal_paths(new)
    if not names:
        return
    ranges = (_scan(spark, names).select(F.col("_metadata")["file_path"].alias("uri"), "ts_unix_ms").groupBy("uri")
              .agg(F.count(F.lit(1)).alias("rows"), F.min("ts_unix_ms").alias("first_ms"), F.max("ts_unix_ms").alias("last_ms")))
    entries = new.join(ranges, "uri", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    entries.select(*[f.split()[0] for f in INDEX.split(", ")]).write.mode("append").parquet(index)
