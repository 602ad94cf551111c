"""Table writers. Output is range-partitioned, so no day, series or period is one task or one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetpulse.durations import micros
from fleetpulse.functions.text import encode_buckets, encode_labels, sanitize_name
from fleetpulse.operators.histograms import rollup_row
from fleetpulse.schema import RECORDING, U64


def recording_rows(df: DataFrame) -> DataFrame:
    """Snapshot rows (ts, name, labels, kind, unit, raw, buckets) in the recording schema."""
    return df.select(F.unix_millis("ts").alias("ts_unix_ms"), "name", encode_labels("labels").alias("labels_json"),
                     "kind", "unit", F.col("raw").cast(U64).alias("raw"),
                     encode_buckets("buckets").alias("buckets_json")).select(*RECORDING.fieldNames())


def write_recording(df: DataFrame, path: str, period="1 hour", partitions: int | None = None) -> None:
    """Append snapshots, one directory per period; files appear complete or not at all."""
    ms = micros(period) // 1000
    start = F.col("ts_unix_ms") - F.pmod(F.col("ts_unix_ms"), F.lit(ms))
    rows = recording_rows(df).withColumn("period", start)
    order = ("period", "name", "labels_json", "ts_unix_ms")
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    (ranged.sortWithinPartitions(*order).write.mode("append").option("compression", "snappy")
     .partitionBy("period").parquet(path))


def sample_rows(df: DataFrame) -> DataFrame:
    """Snapshot rows in the roll-up schema; percentiles are 0 without events."""
    rows = df.select("ts", sanitize_name("name", "rollup").alias("name"), F.col("labels").alias("tags"),
                     F.col("raw").cast(U64).alias("raw"), "buckets")
    return rollup_row(rows).drop("buckets")


def write_samples(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Append roll-up rows to a table partitioned by date and sorted by name, tags and time.

    The range keys include the time, so a day's hot series spreads over many
    files, and the sorted names give every file narrow min/max statistics.
    """
    rows = sample_rows(df).withColumns({"date": F.to_date("ts"), "__key": encode_labels("tags")})
    order = ("date", "name", "__key", "ts")
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("__key").write.mode("append").partitionBy("date").parquet(path)


def apply_retention(df: DataFrame, as_of, days: int = 30, ts: str = "ts") -> DataFrame:
    """Rows whose date has not expired at ``as_of``. On a table with a ``date`` partition it prunes directories."""
    date = F.col("date") if "date" in df.columns else F.to_date(ts)
    return df.where(date > F.date_sub(F.to_date(F.lit(as_of)), days))
