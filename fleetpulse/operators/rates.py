"""Counters to rates, per-entity deltas and their guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.durations import micros
from fleetpulse.operators.chunks import DEFAULT_CHUNK, running_total, with_previous
from fleetpulse.operators.spacing import kept_chain
from fleetpulse.schema import SERIES, U64, u64

_HALF = 2**63


def counter_rate(df: DataFrame, min_dt=0.005, keys: Sequence[str] = SERIES, value: str = "raw",
                 tie: str | None = None, chunk=DEFAULT_CHUNK) -> DataFrame:
    """Counter readings to rates per second: keys, ``ts``, ``raw``, ``rate``.

    A reading closer than ``min_dt`` to the last kept one is skipped, so its
    increase is averaged into the next rate. A decrease is a reset: the reading
    becomes the new baseline without a rate. The first reading has none either.
    """
    keys = list(keys)
    kept = kept_chain(df.withColumn("__v", ordered_long(value)), keys, "ts", min_dt, "__v", tie, chunk)
    return rates_of_chain(kept, keys)


def ordered_long(value) -> Column:
    """Unsigned 64-bit values as signed longs of the same order, shifted by 2^63."""
    value = F.col(value) if isinstance(value, str) else value
    return (value.cast(U64) - u64(_HALF)).cast("bigint")


def rates_of_chain(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates between chained readings (us, value, prev_us, prev_value); resets and firsts give none."""
    rated = kept.where("prev_us is not null and value >= prev_value")
    # Subtracted as decimals: the full unsigned range does not fit a long.
    delta = F.col("value").cast(U64) - F.col("prev_value").cast(U64)
    seconds = (F.col("us") - F.col("prev_us")).cast("double") / F.lit(1e6)
    return rated.select(
        *keys, F.timestamp_micros("us").alias("ts"), (F.col("value").cast(U64) + u64(_HALF)).cast(U64).alias("raw"),
        F.round(delta.cast("double") / seconds).cast(U64).alias("rate"))


def raw_rate(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "raw", tie: Sequence[str] = (),
             chunk=DEFAULT_CHUNK, start=None, end=None) -> DataFrame:
    """Rate against the directly preceding row; null on the first row, a reset or equal times.

    ``start``/``end`` (inclusive) cut the output only, so the first row in range
    may use the row just before it.
    """
    df = df.withColumn("__v", F.col(value).cast(U64))
    out = with_previous(df, keys, ["ts", *tie], {"__pts": "ts", "__pv": "__v"}, chunk)
    dt = F.unix_micros("ts") - F.unix_micros("__pts")
    delta = F.col("__v") - F.col("__pv")
    out = out.withColumn("rate", F.when((dt > 0) & (delta >= 0),
                                        delta.cast("double") / (dt.cast("double") / F.lit(1e6))))
    if start is not None:
        out = out.where(F.col("ts") >= start)
    if end is not None:
        out = out.where(F.col("ts") <= end)
    return out.drop("__v", "__pts", "__pv")


def entity_delta(df: DataFrame, entity: Sequence[str], tick: str, value: str, group: str,
                 chunk=10_000, ticks: str = "consecutive", scope: Sequence[str] = ()) -> DataFrame:
    """Increase of each entity since the previous tick, 0 where there is no usable baseline.

    No baseline: first sight, another ``group``, a decrease, or absence from the
    previous tick. Ticks number the dumps (``consecutive``); with ``observed`` the
    previous tick is the newest smaller one seen in ``scope``.
    """
    entity = list(entity)
    out = with_previous(df, entity, [tick], {"__pt": tick, "__pv": value, "__pg": group}, chunk)
    if ticks == "consecutive":
        adjacent = F.col("__pt") == F.col(tick) - 1
    else:
        seen = with_previous(df.select(*scope, tick).distinct(), scope, [tick], {"__before": tick}, chunk)
        out = out.join(seen, [*scope, tick])
        adjacent = F.col("__pt") == F.col("__before")
    usable = adjacent & (F.col("__pg") == F.col(group)) & (F.col(value) >= F.col("__pv"))
    return (out.withColumn("delta", F.when(usable, F.col(value) - F.col("__pv")).otherwise(F.lit(0)))
            .drop("__pt", "__pv", "__pg", "__before"))


def queue_delta(df: DataFrame, keys: Sequence[str] = ("iface", "queue"), tick: str = "ts",
                value: str = "value", chunk=DEFAULT_CHUNK) -> DataFrame:
    """Increase per queue, never negative; a first sight has no row, an idle queue has 0."""
    out = with_previous(df, keys, [tick], {"__pv": value}, chunk).where(F.col("__pv").isNotNull())
    rise = F.when(F.col(value) >= F.col("__pv"), F.col(value) - F.col("__pv")).otherwise(F.lit(0))
    return out.withColumn("delta", rise.cast(df.schema[value].dataType)).drop("__pv")


def multiplex_scale(df: DataFrame, keys: Sequence[str] = ("source", "cpu", "group"), ts: str = "ts",
                    chunk=DEFAULT_CHUNK) -> DataFrame:
    """Cumulative counts scaled by enabled/running time, one row per (reading, event).

    A clock running backwards, or another number of events, counts from zero.
    ``coverage`` is the share of the interval the group was scheduled, in percent.
    """
    keys = list(keys)
    held = with_previous(df, keys, [ts], {"__pe": "enabled", "__pr": "running", "__pc": "counts"}, chunk)
    reset = F.coalesce((F.col("enabled") < F.col("__pe")) | (F.col("running") < F.col("__pr"))
                       | (F.size("counts") != F.size("__pc")), F.lit(True))
    wide = "decimal(38,0)"
    held = (held.withColumn("__reset", reset)
            .withColumn("__de", F.when(reset, F.col("enabled")).otherwise(F.col("enabled") - F.col("__pe")).cast(wide))
            .withColumn("__dr", F.when(reset, F.col("running")).otherwise(F.col("running") - F.col("__pr")).cast(wide)))
    rows = held.select(*keys, ts, "__reset", "__de", "__dr", "__pc", F.posexplode("counts").alias("event", "__c"))
    count = F.col("__c").cast(wide)
    before = F.when(F.col("__reset"), F.lit(0).cast(wide)).otherwise(F.try_element_at("__pc", F.col("event") + 1).cast(wide))
    delta = F.greatest(count - before, F.lit(0).cast(wide))
    product = (delta * F.col("__de")).cast(wide)
    # Exact integer division: remove the remainder first.
    scaled = F.when(F.col("__dr") > 0, ((product - product % F.col("__dr")) / F.col("__dr")).cast(U64)).otherwise(
        F.lit(0).cast(U64))
    share = (F.col("__dr") * 100).cast(wide)
    coverage = F.when(F.col("__de") == 0, F.lit(0)).otherwise(
        F.least(F.floor(((share - share % F.col("__de")) / F.col("__de")).cast("double")), F.lit(100))).cast("int")
    rows = rows.select(*keys, ts, "event", scaled.alias("__scaled"), coverage.alias("coverage"))
    out = running_total(rows, [*keys, "event"], [ts], "__scaled", "total", chunk)
    return out.select(*keys, ts, "event", F.col("total").cast(U64).alias("total"), "coverage")


def layout_guard(df: DataFrame, keys: Sequence[str] = ("iface",), tick: str = "ts",
                 chunk=DEFAULT_CHUNK) -> DataFrame:
    """Drop snapshots whose number of statistics differs from the previous snapshot's (or is the first)."""
    keys = list(keys)
    sizes = df.groupBy(*keys, tick).agg(F.count(F.lit(1)).alias("__n"))
    stable = (with_previous(sizes, keys, [tick], {"__pn": "__n"}, chunk)
              .where(F.col("__n") == F.col("__pn")).select(*keys, tick))
    return df.join(stable, [*keys, tick], "left_semi")


def queue_delta_guarded(df: DataFrame, keys: Sequence[str] = ("iface",), queue: Sequence[str] = ("queue",), tick: str = "ts",
                        value: str = "value", chunk=DEFAULT_CHUNK) -> DataFrame:
    """Increase per queue under a layout guard: a change of the number of statistics (and the first snapshot)
    drops its snapshot and forgets all baselines of its interface, so the next snapshot has first sights only."""
    keys = list(keys)
    sizes = df.groupBy(*keys, tick).agg(F.count(F.lit(1)).alias("__n"))
    changed = F.coalesce(F.col("__n") != F.col("__pn"), F.lit(True)).cast("bigint")
    layouts = running_total(with_previous(sizes, keys, [tick], {"__pn": "__n"}, chunk).withColumn("__changed", changed),
                            keys, [tick], "__changed", "__layout", chunk)
    stable = layouts.where(F.col("__changed") == 0).select(*keys, tick, "__layout")
    return queue_delta(df.join(stable, [*keys, tick]), [*keys, *queue, "__layout"], tick, value, chunk).drop("__layout")


def irate(df: DataFrame, range="5m", at=None, every=None, keys: Sequence[str] = SERIES,
          value: str = "raw", tie: Sequence[str] = ()) -> DataFrame:
    """Instant rate from the last two points within ``range`` of each evaluation instant.

    Evaluate once (``at``) or on the grid of multiples of ``every``. After a reset
    the later value itself is the increase.
    """
    keys, reach = list(keys), micros(range)
    us = F.unix_micros("ts")
    if at is not None:
        end = F.unix_micros(F.lit(at).cast("timestamp"))
        rows = df.where((us <= end) & (us > end - reach)).withColumn("__at", end)
    else:
        step = micros(every)
        first = us + F.pmod(-us, F.lit(step))
        grid = F.when(first < us + reach, F.sequence(first, us + F.lit(reach - 1), F.lit(step).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>"))
        rows = df.withColumn("__at", F.explode(grid))
    newest = Window.partitionBy(*keys, "__at").orderBy(F.desc("ts"), *[F.desc(t) for t in tie])
    # The rank filter prunes to two rows per series and instant before the shuffle.
    last_two = (rows.select(*keys, "__at", "ts", *tie, F.col(value).cast(U64).alias("__v"))
                .withColumn("__rank", F.row_number().over(newest)).where("__rank <= 2"))
    pair = last_two.groupBy(*keys, "__at").agg(
        *[F.max(F.when(F.col("__rank") == r, c)).alias(f"__{n}{r}")
          for r in (1, 2) for n, c in (("t", F.unix_micros("ts")), ("v", F.col("__v")))])
    dt = (F.col("__t1") - F.col("__t2")).cast("double") / F.lit(1e6)
    rise = F.when(F.col("__v1") >= F.col("__v2"), F.col("__v1") - F.col("__v2")).otherwise(F.col("__v1"))
    return (pair.where(F.col("__t2").isNotNull() & (F.col("__t1") > F.col("__t2")))
            .select(*keys, F.timestamp_micros("__at").alias("at"), (rise.cast("double") / dt).alias("rate")))
