"""Ordered operators over series of any length.

A plain window partitions by series, so one series holding a third of all rows
is one task. Here a series is cut into time chunks and the window partitions by
(series, chunk). What a chunk needs from the past is one *seed* row, computed by
a map-side combined aggregate per chunk and a small window over chunk summaries;
seeds are unioned in, order first, and dropped after the window. The result
equals that of the uncut window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from fleetpulse.durations import micros

CHUNK, SEED = "__chunk", "__seed"
DEFAULT_CHUNK = "10 minutes"


def chunk_of(df: DataFrame, column: str, width) -> Column:
    """Start of the chunk holding ``column`` (a timestamp, or a number cut by a numeric width)."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        at, width = F.unix_micros(column), micros(width)
    else:
        at, width = F.col(column).cast("bigint"), int(width)
    return at - F.pmod(at, F.lit(width))


def _edges(body: DataFrame, keys, order, columns, last: bool) -> DataFrame:
    pick, edge = (F.max_by, F.max) if last else (F.min_by, F.min)
    rest = [c for c in columns if c not in order and c not in keys]
    if len(order) == 1:
        # Scalar buffers: stays a hash aggregate.
        return body.groupBy(*keys, CHUNK).agg(
            edge(order[0]).alias(order[0]), *[pick(c, order[0]).alias(c) for c in rest])
    row = pick(F.struct(*order, *rest), F.struct(*order)).alias("__row")
    return body.groupBy(*keys, CHUNK).agg(row).select(*keys, CHUNK, "__row.*")


def seeded(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
           width, ahead: bool = False) -> tuple[DataFrame, WindowSpec]:
    """``df`` with one seed per chunk (the neighbouring chunk's nearest row) and the window to use.

    ``order`` must be unique within a series for a deterministic result.
    """
    keys, order = list(keys), list(order)
    body = df.withColumn(CHUNK, chunk_of(df, order[0], width) if width is not None else F.lit(0).cast("bigint"))
    body = body.withColumn(SEED, F.lit(False))
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    if width is None:
        return body, window
    per_series = Window.partitionBy(*keys).orderBy(CHUNK)
    neighbour = F.lag(CHUNK).over(per_series) if ahead else F.lead(CHUNK).over(per_series)
    seeds = (_edges(body, keys, order, columns, last=not ahead)
             .withColumn(CHUNK, neighbour).where(F.col(CHUNK).isNotNull())
             .withColumn(SEED, F.lit(True)))
    return body.unionByName(seeds, allowMissingColumns=True), window


def without_seeds(df: DataFrame) -> DataFrame:
    return df.where(~F.col(SEED)).drop(CHUNK, SEED)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  columns: Mapping[str, str], width=DEFAULT_CHUNK, ahead: bool = False) -> DataFrame:
    """Add ``{new: column}`` taken from the previous (or next) row of the same series."""
    both, window = seeded(df, keys, order, list(columns.values()), width, ahead)
    take = F.lead if ahead else F.lag
    return without_seeds(both.select("*", *[take(c).over(window).alias(n) for n, c in columns.items()]))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                  width=DEFAULT_CHUNK) -> DataFrame:
    """Add the running sum of ``value`` along each series."""
    keys, order = list(keys), list(order)
    body = df.withColumn(CHUNK, chunk_of(df, order[0], width) if width is not None else F.lit(0).cast("bigint"))
    body = body.withColumn(SEED, F.lit(False))
    if width is not None:
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        sums = body.groupBy(*keys, CHUNK).agg(F.sum(value).alias(value))
        seeds = (sums.withColumn(value, F.sum(value).over(before).cast(df.schema[value].dataType))
                 .where(F.col(value).isNotNull()).withColumn(SEED, F.lit(True)))
        body = body.unionByName(seeds, allowMissingColumns=True)
    window = (Window.partitionBy(*keys, CHUNK).orderBy(F.desc(SEED), *order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return without_seeds(body.withColumn(out, F.sum(value).over(window)))


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str,
               width=DEFAULT_CHUNK) -> DataFrame:
    """Replace ``column`` by its newest non-null value at or before each row."""
    keys, order = list(keys), list(order)
    body = df.withColumn(CHUNK, chunk_of(df, order[0], width) if width is not None else F.lit(0).cast("bigint"))
    body = body.withColumn(SEED, F.lit(False))
    if width is not None:
        known = F.when(F.col(column).isNotNull(), F.struct(*order))
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        seeds = (body.groupBy(*keys, CHUNK).agg(F.max_by(column, known).alias(column))
                 .withColumn(column, F.last(column, ignorenulls=True).over(before))
                 .where(F.col(column).isNotNull()).withColumn(SEED, F.lit(True)))
        body = body.unionByName(seeds, allowMissingColumns=True)
    window = (Window.partitionBy(*keys, CHUNK).orderBy(F.desc(SEED), *order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return without_seeds(body.withColumn(column, F.last(column, ignorenulls=True).over(window)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
              columns: Sequence[str], width=DEFAULT_CHUNK, shift=0) -> DataFrame:
    """Left rows with ``columns`` of the newest right row not after ``left_at - shift``.

    One union, one exchange: neither side is broadcast and a long series is split.
    Right rows must be unique per (keys, time).
    """
    keys = list(keys)
    left_columns = [c for c in left.columns if c not in keys]
    lag = micros(shift)
    at = F.col(left_at) if not lag else F.timestamp_micros(F.unix_micros(left_at) - F.lit(lag))
    rows = left.select(*keys, at.alias("__at"), F.lit(1).alias("__side"),
                       F.struct(*left_columns).alias("__left"))
    facts = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"),
                         F.struct(*columns).alias("__right"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    joined = last_known(both, keys, ["__at", "__side"], "__right", width).where(F.col("__side") == 1)
    return joined.select(*keys, *[F.col("__left")[c].alias(c) for c in left_columns],
                         *[F.col("__right")[c].alias(c) for c in columns])
