"""One page of an ordered selection, found by order statistics.

Sorting everything to show 50 rows does not scale, and neither does sorting the one hot stretch of time the page
lies in. The page's place is found by counting: rows per time chunk, then, while the stretch still holds too many
rows, counts below a few of its own rows. Each round is one aggregation over a narrower range, and its answer is a
single row; the last range is small enough to be sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fleetpulse.durations import micros
from fleetpulse.operators.chunks import CHUNK, DEFAULT_CHUNK, chunk_of

SPLITTERS = 24
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_FIRST = -2 ** 63   # the chunk of rows without time, which sort first


def _order_key(df: DataFrame, order: Sequence[str]) -> Column:
    def part(name):
        kind = df.schema[name].dataType
        # Times as numbers or text: their literals then mean the same in every time zone.
        return (F.unix_micros(name) if isinstance(kind, T.TimestampType)
                else F.col(name).cast("string") if isinstance(kind, T.TimestampNTZType) else F.col(name))

    return F.struct(*[part(name).alias(f"k{i}") for i, name in enumerate(order)])


def _literal(key, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(key[i]).cast(field.dataType).alias(field.name) for i, field in enumerate(kind)])


def _touched(df: DataFrame, number: int, size: int, first: str, chunk):
    """(rows of the chunks the page touches, rows before them, the page's first row, rows in them), else None."""
    rows = df.withColumn(CHUNK, F.coalesce(chunk_of(df, first, chunk), F.lit(_FIRST)))
    upto = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n"))
              .withColumns({"end": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy())}))
    last = F.greatest(F.ceil(F.col("total") / F.lit(size)) - 1, F.lit(0))
    spot = (counts.withColumns({"begin": F.col("end") - F.col("n"), "first": F.least(F.lit(number), last) * F.lit(size)})
            .where((F.col("end") > F.col("first")) & (F.col("begin") < F.col("first") + F.lit(size)))
            .agg(F.min(CHUNK).alias("lo"), F.max(CHUNK).alias("hi"), F.min("begin").alias("begin"), F.sum("n").alias("n"),
                 F.max("first").alias("first")).first())
    if spot.lo is None:
        return None
    narrow = rows.where(F.col(CHUNK).between(spot.lo, spot.hi)).drop(CHUNK)
    if spot.lo != _FIRST:
        # Also in bounds of the column itself, by which the scan skips files and row groups.
        timed = isinstance(df.schema[first].dataType, T.TimestampType)
        lo, hi = spot.lo, spot.hi + (micros(chunk) if timed else int(chunk))
        bounds = [F.timestamp_micros(F.lit(v)) if timed else F.lit(v) for v in (lo, hi)]
        narrow = narrow.where((F.col(first) >= bounds[0]) & (F.col(first) < bounds[1]))
    return narrow, spot.begin, spot.first, spot.n


def _narrowed(rows: DataFrame, key: Column, skip: int, size: int):
    """A sub-range of ``rows`` that holds the rows at ``[skip, skip + size)`` of their order, and how many it leaves out before."""
    kind = rows.select(key.alias("k")).schema["k"].dataType
    picked = [r.k for r in rows.select(key.alias("k")).orderBy(F.rand(17)).limit(SPLITTERS).collect()]
    marks = [_literal(k, kind) for k in picked]
    ranks = rows.agg(*[F.count_if(key < m).alias(f"b{i}") for i, m in enumerate(marks)],
                     *[F.count_if(key <= m).alias(f"u{i}") for i, m in enumerate(marks)]).first()
    # Ways to cut: rows from a mark on, rows after it; rows up to before it, rows up to it.
    starts = [(ranks[f"b{i}"], key >= m) for i, m in enumerate(marks)] + [(ranks[f"u{i}"], key > m) for i, m in enumerate(marks)]
    ends = [(ranks[f"b{i}"], key < m) for i, m in enumerate(marks)] + [(ranks[f"u{i}"], key <= m) for i, m in enumerate(marks)]
    start = max((s for s in starts if s[0] <= skip), key=lambda s: s[0], default=(0, F.lit(True)))
    end = min((e for e in ends if e[0] >= skip + size), key=lambda e: e[0], default=(None, F.lit(True)))
    return rows.where(start[1] & end[1]), start[0], end[0]


def page(df: DataFrame, number: int, size: int = 50, order: Sequence[str] = ("ts", "labels_key", "raw"),
         chunk=DEFAULT_CHUNK, few: int = 100_000) -> DataFrame:
    """Rows of one page of the ordered selection with their place ``row``, the number clamped to the last page.

    The place is found by counting jobs that run when this is called; each returns one row. At most ``few`` rows
    (or two pages) are sorted by one task, however many share a time or a chunk; only rows that agree in every plain
    column can be more, and then they are interchangeable. Rows that agree in ``order`` are told apart by the other
    plain columns. Nulls come first. No rows give no page.
    """
    # Equal rows under ``order`` are split by the columns left, so that a tie of any length has an order.
    full = [*order, *[c for c in df.columns if c not in order and not isinstance(df.schema[c].dataType, _NESTED)]]
    at = _touched(df, number, size, order[0], chunk)
    if at is None:
        return df.withColumn("row", F.lit(0).cast("bigint")).limit(0)
    rows, begin, first, held = at
    key, most = _order_key(df, full), max(few, 2 * size)
    while held > most:
        wanted = min(size, held - (first - begin))
        rows, left, upto = _narrowed(rows, key, first - begin, wanted)
        kept = (held if upto is None else upto) - left
        begin += left
        if kept == held:
            break
        held = kept
    ranked = rows.withColumn("row", F.lit(begin).cast("bigint") + F.row_number().over(Window.orderBy(*full)) - 1)
    return ranked.where((F.col("row") >= first) & (F.col("row") < first + size))
