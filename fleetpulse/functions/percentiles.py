"""Nearest-rank percentiles over sparse ascending bucket arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.schema import ROLLUP_COLUMNS, ROLLUP_PERCENTILES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_percentiles(ps: Sequence[float]) -> tuple[float, ...]:
    ps = tuple(float(p) for p in ps)
    if not ps or any(not 0 < p <= 100 for p in ps):
        raise ValueError("percentiles must lie in (0, 100]")
    return ps


def event_total(buckets) -> Column:
    """Number of events behind a bucket array (0 for an empty one)."""
    return F.aggregate(_col(buckets), F.lit(0).cast("decimal(38,0)"),
                       lambda acc, b: (acc + b["count"]).cast("decimal(38,0)"))


def nearest_rank(p: float, total) -> Column:
    """clamp(ceil(p/100 * N), 1, N), in double and in that order."""
    n = _col(total).cast("double")
    return F.greatest(F.lit(1.0), F.least(F.ceil(F.lit(p / 100.0) * n).cast("double"), n))


def _walk(buckets: Column, ps: tuple[float, ...]) -> Column:
    # The total comes first, then one pass answers all percentiles. The ranks
    # travel in the accumulator: inside the lambda they would be computed anew
    # for every bucket.
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + b["count"].cast("double"))
    number = range(len(ps))
    nothing = F.lit(None).cast("decimal(20,0)")

    def state(seen, ranks, answers):
        return F.struct(seen.alias("seen"), F.struct(*[ranks[i].alias(f"r{i}") for i in number]).alias("ranks"),
                        *[answers[i].alias(f"a{i}") for i in number])

    def step(acc, b):
        seen = acc["seen"] + b["count"].cast("double")
        answers = [F.coalesce(acc[f"a{i}"], F.when(seen >= acc["ranks"][f"r{i}"], b["bound"].cast("decimal(20,0)")))
                   for i in number]
        return F.struct(seen.alias("seen"), acc["ranks"].alias("ranks"), *[answers[i].alias(f"a{i}") for i in number])

    def ranked(n):
        return state(F.lit(0.0), [nearest_rank(p, n) for p in ps], [nothing for _ in ps])

    # A one-element transform evaluates the total once.
    start = F.element_at(F.transform(F.array(total), ranked), 1)
    return F.aggregate(buckets, start, step, lambda acc: F.array(*[acc[f"a{i}"] for i in number]))


def percentiles_or_null(buckets, ps: Sequence[float] = ROLLUP_PERCENTILES) -> Column:
    """One bound per percentile; all null without events: missing is not zero."""
    return _walk(_col(buckets), check_percentiles(ps))


def percentiles_from_buckets(buckets, ps: Sequence[float] = ROLLUP_PERCENTILES) -> Column:
    """One bound per percentile; all zero without events."""
    return F.transform(percentiles_or_null(buckets, ps),
                       lambda v: F.coalesce(v, F.lit(0).cast("decimal(20,0)")))


def percentile_columns(df: DataFrame, keys: Sequence[str], ps: Sequence[float] = ROLLUP_PERCENTILES,
                       names: Sequence[str] = ROLLUP_COLUMNS, total: str = "total",
                       bound: str = "bound", count: str = "count") -> DataFrame:
    """The same answers from exploded ``(keys, bound, count)`` rows.

    The running count and the final aggregation share one hash partitioning on
    ``keys``, whose groups hold at most one row per bucket of the grid.
    """
    ps = check_percentiles(ps)
    group = Window.partitionBy(*keys)
    upto = group.orderBy(bound).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.select(*keys, bound, F.sum(count).over(upto).alias("__cum"),
                       F.sum(count).over(group).alias("__total"))
    return ranked.groupBy(*keys).agg(
        F.max("__total").alias(total),
        *[F.min(F.when(F.col("__cum") >= nearest_rank(p, "__total"), F.col(bound))).alias(name)
          for p, name in zip(ps, names, strict=True)])
