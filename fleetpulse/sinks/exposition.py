"""Snapshots as exposition text, JSON lines and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetpulse.functions.percentiles import check_percentiles, percentiles_from_buckets
from fleetpulse.functions.text import label_text, percentile_text, sanitize_name, sorted_labels
from fleetpulse.schema import ROLLUP_PERCENTILES, U64

CSV_COLUMNS = ("ts_unix_ms", "time_utc", "name", "labels_json", "kind", "unit", "raw", "p50", "p90", "p99", "p999")


def exposition_rows(df: DataFrame, ps: Sequence[float] = ROLLUP_PERCENTILES) -> DataFrame:
    """Long rows (family, type, labels, percentile, value): the raw family and one per percentile."""
    return _ranked_rows(df, ps).drop("rank")


def _ranked_rows(df: DataFrame, ps: Sequence[float]) -> DataFrame:
    ps = check_percentiles(ps)
    base = sanitize_name("name", "exposition")
    held = df.select(base.alias("__base"), "kind", "labels", F.col("raw").cast(U64).alias("__raw"),
                     percentiles_from_buckets("buckets", ps).alias("__pct"))
    distribution = F.col("kind") == "distribution"
    raw_family = F.when(distribution, F.concat("__base", F.lit("_count"))).otherwise(F.col("__base"))
    raw_type = F.when(F.col("kind") == "gauge", F.lit("gauge")).otherwise(F.lit("counter"))
    pct_family = F.concat("__base", F.when(F.col("kind") == "gauge", F.lit("_value")).otherwise(F.lit("_rate")))

    def cell(family, kind, rank, percentile, value):
        return F.struct(family.alias("family"), kind.alias("type"), F.lit(rank).alias("rank"),
                        percentile.alias("percentile"), value.cast(U64).alias("value"))

    cells = [cell(raw_family, raw_type, 0, F.lit(None).cast("string"), F.col("__raw"))]
    cells += [cell(pct_family, F.lit("gauge"), i + 1, F.lit(percentile_text(p)), F.col("__pct")[i])
              for i, p in enumerate(ps)]
    return (held.select("labels", F.explode(F.array(*cells)).alias("__c"))
            .select("__c.family", "__c.type", "labels", "__c.percentile", "__c.value", "__c.rank"))


def exposition_lines(df: DataFrame, ps: Sequence[float] = ROLLUP_PERCENTILES) -> DataFrame:
    """Unsorted lines with their sort keys; each family's TYPE line exists once."""
    rows = _ranked_rows(df, ps)
    text = label_text("labels", F.col("percentile"))
    samples = rows.select("family", F.lit(1).alias("part"), text.alias("key"), "rank",
                          F.concat("family", text, F.lit(" "), F.col("value").cast("string")).alias("value"))
    types = rows.groupBy("family").agg(F.min("type").alias("type")).select(
        "family", F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(0).alias("rank"),
        F.concat(F.lit("# TYPE "), "family", F.lit(" "), "type").alias("value"))
    return types.unionByName(samples)


def exposition_text(df: DataFrame, ps: Sequence[float] = ROLLUP_PERCENTILES) -> DataFrame:
    """Lines of the exposition text in order: families by name, TYPE first. Globally range-sorted."""
    return exposition_lines(df, ps).orderBy("family", "part", "key", "rank").select("value")


def write_exposition(df: DataFrame, path: str, ps: Sequence[float] = ROLLUP_PERCENTILES) -> None:
    exposition_text(df, ps).write.mode("overwrite").text(path)


def export_json(df: DataFrame, ps: Sequence[float] = ROLLUP_PERCENTILES) -> DataFrame:
    """One JSON object per series."""
    ps = sorted(check_percentiles(ps), key=percentile_text)
    pct = percentiles_from_buckets("buckets", ps)
    names = F.array(*[F.lit(percentile_text(p)) for p in ps])
    return df.select(F.to_json(F.struct(
        "name", sorted_labels("labels").alias("labels"), F.col("raw").cast(U64).alias("raw"),
        F.map_from_arrays(names, pct).alias("percentiles"))).alias("value"))


def csv_rows(df: DataFrame) -> DataFrame:
    """The eleven export columns as text, safe to open in a spreadsheet."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    source = {"ts_unix_ms": F.unix_millis("ts"), "time_utc": stamp, "labels_json": F.col("labels_key")}
    return df.select(*[
        F.regexp_replace(F.coalesce(source.get(c, F.col(c)).cast("string"), F.lit("")), "^([=+@-])", "'$1").alias(c)
        for c in CSV_COLUMNS])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with every cell quoted and CRLF line ends; each part file carries the header."""
    (csv_rows(df).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "")
     .csv(path))
