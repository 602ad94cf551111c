"""Mergeable bucket counts: slices, windows and cumulative distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.durations import micros
from fleetpulse.functions.h2 import (
    KERNEL_GROUPING, KERNEL_MAX_POWER, WINDOW_GROUPING, WINDOW_MAX_POWER, h2_bound,
    h2_bound_of_index, is_clamped)
from fleetpulse.functions.percentiles import percentiles_from_buckets
from fleetpulse.operators.chunks import DEFAULT_CHUNK, asof_join
from fleetpulse.operators.spacing import spaced_times
from fleetpulse.schema import ROLLUP_COLUMNS, ROLLUP_PERCENTILES, SERIES


def slice_histogram(df: DataFrame, width="100 ms", align: str = "epoch", keys: Sequence[str] = SERIES,
                    value: str = "raw", g: int = WINDOW_GROUPING, n: int = WINDOW_MAX_POWER) -> DataFrame:
    """Events per (series, slice, bucket) with the number that had to be clamped.

    The aggregate combines map-side, so a hot series leaves each task as at most
    one row per (slice, bucket).
    """
    w = micros(width)
    at = F.unix_micros("ts")
    if align == "origin":
        # Slice 0 starts at the series' first instant.
        first = df.groupBy(*keys).agg(F.min(at).alias("__origin"))
        df, at = df.join(first, list(keys)), at - F.col("__origin")
    elif align != "epoch":
        raise ValueError("align must be 'epoch' or 'origin'")
    return (df.select(*keys, ((at - F.pmod(at, F.lit(w))) / F.lit(w)).cast("bigint").alias("slice"),
                      h2_bound(value, g, n).alias("bound"),
                      is_clamped(value, n).cast("bigint").alias("__over"))
            .groupBy(*keys, "slice", "bound")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("__over").alias("clamped")))


gauge_window = slice_histogram


def sliding_histogram(slices: DataFrame, window="60 s", step="10 s", width="100 ms",
                      keys: Sequence[str] = SERIES) -> DataFrame:
    """Bucket counts of the window ending with slice ``window_slice``, at every step.

    Slices first merge into panes of the greatest common width, then each pane
    is copied to the windows it serves: the copy factor is window/pane, not
    window/slice.
    """
    w = micros(width)
    per_window, per_step = max(1, micros(window) // w), max(1, micros(step) // w)
    pane = math.gcd(per_window, per_step)
    reach, stride = per_window // pane, per_step // pane
    at = F.col("slice")
    panes = (slices.select(*keys, ((at - F.pmod(at, F.lit(pane))) / F.lit(pane)).cast("bigint").alias("__pane"),
                           "bound", "count")
             .groupBy(*keys, "__pane", "bound").agg(F.sum("count").alias("count")))
    p = F.col("__pane")
    # First window end not before this pane: windows end where (end + 1) % stride == 0.
    first = p + F.pmod(-(p + 1), F.lit(stride))
    last = p + F.lit(reach - 1)
    ends = F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))
    return (panes.select(*keys, F.explode(ends).alias("__end"), "bound", "count")
            .groupBy(*keys, ((F.col("__end") + 1) * F.lit(pane) - 1).alias("window_slice"), "bound")
            .agg(F.sum("count").alias("count")))


def bucket_array(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Sparse ascending array per key; bounded by the bucket grid, not by the data."""
    keys = [c for c in df.columns if c not in ("bound", "count", "clamped")] if keys is None else keys
    return df.where(F.col("count") > 0).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bound", "count"))).alias("buckets"))


def dense_to_sparse(df: DataFrame, counts: str = "counts", out: str = "buckets",
                    g: int = KERNEL_GROUPING, n: int = KERNEL_MAX_POWER) -> DataFrame:
    """Positional counts to a sparse array, row by row; a short input counts as padded."""
    pairs = F.transform(F.col(counts), lambda c, i: F.struct(
        h2_bound_of_index(i, g, n).alias("bound"), c.alias("count")))
    return df.withColumn(out, F.filter(pairs, lambda b: b["count"] > 0))


def rollup_row(df: DataFrame, buckets: str = "buckets", ps: Sequence[float] = ROLLUP_PERCENTILES,
               names: Sequence[str] = ROLLUP_COLUMNS) -> DataFrame:
    """Fixed percentile columns, 0 where there were no events."""
    held = df.withColumn("__pct", percentiles_from_buckets(buckets, ps))
    return held.select(*df.columns, *[
        F.col("__pct")[i].cast("bigint").alias(n) for i, n in enumerate(names)])


def subtract_buckets(newer, older) -> Column:
    """``newer - older`` per bound, never below zero, zero counts dropped."""
    newer = F.col(newer) if isinstance(newer, str) else newer
    older = F.col(older) if isinstance(older, str) else older
    base = F.map_from_arrays(F.transform(older, lambda b: b["bound"]), F.transform(older, lambda b: b["count"]))
    left = F.transform(newer, lambda b: F.struct(
        b["bound"].alias("bound"),
        F.greatest(b["count"] - F.coalesce(F.try_element_at(base, b["bound"]), F.lit(0)), F.lit(0))
        .cast("bigint").alias("count")))
    return F.filter(left, lambda b: b["count"] > 0)


def windowed_distribution(df: DataFrame, window="60 s", thin: bool = False, keys: Sequence[str] = SERIES,
                          buckets: str = "buckets", chunk=DEFAULT_CHUNK) -> DataFrame:
    """Trailing-window counts of cumulative bucket arrays.

    Baseline: the newest checkpoint at least ``window`` old, the full counts until
    one exists. Every reading is a checkpoint; with ``thin`` only readings spaced
    by an eighth of the window are. ``raw`` stays the cumulative event total.
    """
    keys = list(keys)
    readings = df.select(*keys, "ts", F.col(buckets).alias("__now"))
    # Which baseline a reading has is found on times alone; arrays then meet by equality.
    times = readings.select(*keys, "ts").distinct()
    checkpoints = spaced_times(times, keys, "ts", micros(window) // 8 / 1e6, chunk=chunk) if thin else times
    base = checkpoints.select(*keys, F.col("ts").alias("baseline_ts"))
    chosen = asof_join(times, base, keys, "ts", "baseline_ts", ["baseline_ts"], chunk, shift=window)
    arrays = readings.dropDuplicates([*keys, "ts"]).select(*keys, F.col("ts").alias("baseline_ts"), F.col("__now").alias("__base"))
    joined = readings.join(chosen, [*keys, "ts"], "left").join(arrays, [*keys, "baseline_ts"], "left")
    full = F.transform("__now", lambda b: F.struct(
        b["bound"].alias("bound"), b["count"].cast("bigint").alias("count")))
    return joined.select(
        *keys, "ts", "baseline_ts",
        F.aggregate("__now", F.lit(0).cast("bigint"), lambda a, b: a + b["count"].cast("bigint")).alias("raw"),
        F.when(F.col("__base").isNull(), F.filter(full, lambda b: b["count"] > 0))
        .otherwise(subtract_buckets("__now", "__base")).alias("buckets"))


def expire_stale(df: DataFrame, now, interval="100 ms", slice="100 ms", last_update: str = "last_update",
                 buckets: str = "buckets") -> DataFrame:
    """Empty the buckets of a distribution nobody has fed for max(3 intervals, 10 slices)."""
    limit = max(3 * micros(interval), 10 * micros(slice))
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros(last_update)
    empty = F.array().cast(df.schema[buckets].dataType)
    return df.withColumn(buckets, F.when(age > F.lit(limit), empty).otherwise(F.col(buckets)))
