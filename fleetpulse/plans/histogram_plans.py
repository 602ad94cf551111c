"""Queries for bucket and percentile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions.h2 import h2_bound, h2_bound_of_index, h2_clamp, h2_index, is_clamped
from fleetpulse.functions.percentiles import event_total, percentiles_from_buckets, percentiles_or_null
from fleetpulse.functions.text import encode_buckets
from fleetpulse.operators import histograms as H
from fleetpulse.operators.chunks import running_total
from fleetpulse.operators.rollups import latest_snapshot
from fleetpulse.plans.adapters import (
    CENTS, DAY_US, HOUR_US, OBS_GAUGE, bound_sql, cents, events, obs_gauge, percentiles_sql, rank_sql, table)
from fleetpulse.plans.registry import plan
from fleetpulse.schema import SERIES, U64


@plan("rollup_percentiles", f"""WITH {OBS_GAUGE},
b AS (SELECT event_type, us // {DAY_US} AS day, {bound_sql('raw')} AS bound, count(*) AS c FROM obs GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER (PARTITION BY event_type, day ORDER BY bound) AS cum,
    sum(c) OVER (PARTITION BY event_type, day) AS n FROM b)
SELECT event_type, day, CAST(max(n) AS BIGINT) AS n, {percentiles_sql()} FROM cm GROUP BY event_type, day""")
def rollup_percentiles(spark, sf):
    slices = H.slice_histogram(obs_gauge(spark, sf), "1 day", keys=["event_type"])
    rows = H.bucket_array(slices, ["event_type", "slice"])
    return H.rollup_row(rows.withColumn("n", event_total("buckets").cast("bigint"))).select(
        "event_type", F.col("slice").alias("day"), "n", "p50", "p90", "p99", "p999")


@plan("h2_bounds", f"""WITH v AS (SELECT l_orderkey * 1000003 * l_linenumber + l_partkey AS v, l_suppkey FROM lineitem)
SELECT {bound_sql('v')} AS bound, {bound_sql('v', 3)} AS coarse, count(*) AS n, min(v) AS low, max(v) AS high FROM v GROUP BY ALL""")
def h2_bounds(spark, sf):
    v = (F.col("l_orderkey") * 1000003 * F.col("l_linenumber") + F.col("l_partkey")).alias("v")
    return (table(spark, sf, "lineitem").select(v)
            .groupBy(h2_bound("v").alias("bound"), h2_bound("v", 3, 52).alias("coarse"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))


@plan("h2_indexes", """WITH v AS (SELECT l_orderkey * 1000003 * l_linenumber + l_partkey AS v FROM lineitem),
p AS (SELECT v, length(bin(v)) - 1 AS p FROM v)
SELECT CAST(CASE WHEN v < 16 THEN v ELSE (p - 2) * 8 + ((v - (1::BIGINT << p)) >> (p - 3)) END AS BIGINT) AS idx, count(*) AS n
FROM p GROUP BY ALL""")
def h2_indexes(spark, sf):
    v = (F.col("l_orderkey") * 1000003 * F.col("l_linenumber") + F.col("l_partkey")).alias("v")
    return (table(spark, sf, "lineitem").select(v).groupBy(h2_index("v", 3, 64).cast("bigint").alias("idx"))
            .agg(F.count(F.lit(1)).alias("n")))


@plan("h2_clamped", """WITH v AS (SELECT l_orderkey * 400000000000 * l_linenumber AS v, l_returnflag FROM lineitem)
SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(v > 4503599627370495 AS INT)) AS BIGINT) AS clamped,
    max(least(v, 4503599627370495)) AS top FROM v GROUP BY ALL""")
def h2_clamped(spark, sf):
    # DECIMAL: from l_orderkey 3,294,062 on the product can pass 64 bits
    v = (F.col("l_orderkey").cast(U64) * 400000000000 * F.col("l_linenumber")).alias("v")
    return (table(spark, sf, "lineitem").select(v, "l_returnflag").groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_clamped("v")).alias("clamped"), F.max(h2_clamp("v")).alias("top")))


SLICES = f"""sl AS (SELECT name, labels_key, us // {HOUR_US} AS slice, {bound_sql('raw')} AS bound, count(*) AS c FROM obs GROUP BY ALL)"""


@plan("slice_histogram", f"""WITH {OBS_GAUGE}, {SLICES} SELECT labels_key, slice, bound, c AS n, 0::BIGINT AS clamped FROM sl""")
def slice_histogram(spark, sf):
    return (H.slice_histogram(obs_gauge(spark, sf), "1 hour")
            .select("labels_key", "slice", "bound", F.col("count").alias("n"), "clamped"))


@plan("slice_histogram_origin", f"""WITH {OBS_GAUGE},
o AS (SELECT *, min(us) OVER (PARTITION BY labels_key) AS origin FROM obs)
SELECT labels_key, (us - origin) // {HOUR_US} AS slice, {bound_sql('raw')} AS bound, count(*) AS n FROM o GROUP BY ALL""")
def slice_histogram_origin(spark, sf):
    return (H.gauge_window(obs_gauge(spark, sf), "1 hour", align="origin")
            .select("labels_key", "slice", "bound", F.col("count").alias("n")))


def _sliding_sql(slices: int, step: int) -> str:
    return f"""grid AS (SELECT DISTINCT labels_key, k FROM (SELECT labels_key, unnest(range(slice, slice + {slices})) AS k FROM sl)
    WHERE (k + 1) % {step} = 0),
win AS (SELECT g.labels_key, g.k, s.bound, CAST(sum(s.c) AS BIGINT) AS c FROM grid g JOIN sl s
    ON s.labels_key = g.labels_key AND s.slice BETWEEN g.k - {slices - 1} AND g.k GROUP BY ALL)"""


@plan("sliding_histogram", f"""WITH {OBS_GAUGE}, {SLICES}, {_sliding_sql(24, 6)}
SELECT labels_key, k AS window_slice, bound, c AS n FROM win""")
def sliding_histogram(spark, sf):
    slices = H.slice_histogram(obs_gauge(spark, sf), "1 hour")
    return (H.sliding_histogram(slices, "24 hours", "6 hours", "1 hour")
            .select("labels_key", "window_slice", "bound", F.col("count").alias("n")))


@plan("sliding_histogram_every_slice", f"""WITH {OBS_GAUGE}, {SLICES}, {_sliding_sql(10, 1)}
SELECT labels_key, k AS window_slice, bound, c AS n FROM win""")
def sliding_histogram_every_slice(spark, sf):
    slices = H.slice_histogram(obs_gauge(spark, sf), "1 hour")
    return (H.sliding_histogram(slices, "10 hours", "1 hour", "1 hour")
            .select("labels_key", "window_slice", "bound", F.col("count").alias("n")))


@plan("sliding_percentiles", f"""WITH {OBS_GAUGE}, {SLICES}, {_sliding_sql(24, 6)},
cm AS (SELECT labels_key, k, bound, sum(c) OVER (PARTITION BY labels_key, k ORDER BY bound) AS cum,
    sum(c) OVER (PARTITION BY labels_key, k) AS n FROM win)
SELECT labels_key, k AS window_slice, {percentiles_sql()} FROM cm GROUP BY labels_key, k""")
def sliding_percentiles(spark, sf):
    slices = H.slice_histogram(obs_gauge(spark, sf), "1 hour")
    windows = H.sliding_histogram(slices, "24 hours", "6 hours", "1 hour")
    return H.rollup_row(H.bucket_array(windows, [*SERIES, "window_slice"])).select(
        "labels_key", "window_slice", "p50", "p90", "p99", "p999")


@plan("bucket_arrays", f"""WITH {OBS_GAUGE}, {SLICES}
SELECT labels_key, slice, '[' || string_agg('[' || bound || ',' || c || ']', ',' ORDER BY bound) || ']' AS buckets_json FROM sl
GROUP BY labels_key, slice""")
def bucket_arrays(spark, sf):
    slices = H.slice_histogram(obs_gauge(spark, sf), "1 hour")
    return H.bucket_array(slices, [*SERIES, "slice"]).select(
        "labels_key", "slice", encode_buckets("buckets").alias("buckets_json"))


@plan("dense_to_sparse", """WITH i AS (SELECT l_suppkey AS series, CAST(l_partkey % 200 AS BIGINT) AS idx, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT series, CASE WHEN idx < 16 THEN idx ELSE ((8 + idx % 8 + 1) << (idx // 8 - 1)) - 1 END AS bound, c AS n FROM i""")
def dense_to_sparse(spark, sf):
    cells = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("series"), (F.col("l_partkey") % 200).alias("idx"))
             .agg(F.count(F.lit(1)).alias("c")))
    # 200 positions per series: a bounded array.
    dense = cells.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("idx", "c"))).alias("m")).select(
        "series", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.coalesce(
            F.try_element_at("m", i.cast("bigint")), F.lit(0).cast("bigint"))).alias("counts"))
    return (H.dense_to_sparse(dense).select("series", F.explode("buckets").alias("b"))
            .select("series", F.col("b.bound").cast("bigint").alias("bound"), F.col("b.count").alias("n")))


PCT = (1, 25, 50, 75, 100)


@plan("percentiles_from_buckets", f"""WITH {OBS_GAUGE},
b AS (SELECT user_id, {bound_sql('raw')} AS bound, count(*) AS c FROM obs GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY bound) AS cum, sum(c) OVER (PARTITION BY user_id) AS n FROM b)
SELECT user_id, {', '.join(f'{rank_sql(p)} AS p{p}' for p in PCT)} FROM cm GROUP BY user_id""")
def percentiles_of_users(spark, sf):
    arrays = H.bucket_array(H.slice_histogram(obs_gauge(spark, sf), "36500 days", keys=["user_id"]), ["user_id"])
    pct = percentiles_from_buckets("buckets", PCT)
    return arrays.select("user_id", pct.alias("p")).select(
        "user_id", *[F.col("p")[i].cast("bigint").alias(f"p{p}") for i, p in enumerate(PCT)])


@plan("percentiles_or_null", f"""WITH {OBS_GAUGE},
b AS (SELECT event_type, us // {DAY_US} AS day, {bound_sql('raw')} AS bound, count(*) AS c FROM obs WHERE raw > 20000 GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER (PARTITION BY event_type, day ORDER BY bound) AS cum, sum(c) OVER (PARTITION BY event_type, day) AS n FROM b),
g AS (SELECT event_type, day, {rank_sql(50)} AS p50, {rank_sql(99)} AS p99 FROM cm GROUP BY event_type, day),
d AS (SELECT DISTINCT event_type, us // {DAY_US} AS day FROM obs)
SELECT d.event_type, d.day, g.p50, g.p99, coalesce(g.p50, 0) AS p50_or_zero FROM d LEFT JOIN g USING (event_type, day)""")
def percentiles_of_large_values(spark, sf):
    # Days without a large value keep an empty histogram.
    counts = H.slice_histogram(obs_gauge(spark, sf).withColumn("big", F.col("raw") > 20000), "1 day", keys=["event_type", "big"])
    kept = counts.groupBy("event_type", "slice").agg(F.array_sort(F.collect_list(
        F.when(F.col("big"), F.struct("bound", "count")))).alias("buckets"))
    two = kept.select("event_type", F.col("slice").alias("day"), percentiles_or_null("buckets", (50, 99)).alias("p"),
                      percentiles_from_buckets("buckets", (50,)).alias("z"))
    return two.select("event_type", "day", F.col("p")[0].cast("bigint").alias("p50"), F.col("p")[1].cast("bigint").alias("p99"),
                      F.col("z")[0].cast("bigint").alias("p50_or_zero"))


CUMULATIVE = f"""daily AS (SELECT labels_key, us // {DAY_US} AS day, {bound_sql('raw', 3)} AS bound, count(*) AS c FROM obs GROUP BY ALL),
days AS (SELECT DISTINCT labels_key, day FROM daily), bounds AS (SELECT DISTINCT labels_key, bound FROM daily),
cum AS (SELECT d.labels_key, d.day, b.bound, CAST(sum(x.c) AS BIGINT) AS c FROM days d JOIN bounds b USING (labels_key)
    JOIN daily x ON x.labels_key = d.labels_key AND x.bound = b.bound AND x.day <= d.day GROUP BY ALL)"""


def cumulative_buckets(spark, sf):
    """Daily readings of a cumulative histogram per series (coarse grid)."""
    daily = H.slice_histogram(obs_gauge(spark, sf), "1 day", g=3).select(*SERIES, "slice", "bound", "count")
    days = daily.select(*SERIES, "slice").distinct()
    bounds = daily.select(*SERIES, "bound").distinct()
    # Every day reports every bound seen so far: bounded by the grid.
    full = days.join(bounds, list(SERIES)).join(daily, [*SERIES, "slice", "bound"], "left").fillna(0, ["count"])
    total = running_total(full, [*SERIES, "bound"], ["slice"], "count", "total", 7)
    rows = total.where("total > 0").select(*SERIES, "slice", "bound", F.col("total").alias("count"))
    return H.bucket_array(rows, [*SERIES, "slice"]).withColumn("ts", F.timestamp_micros(F.col("slice") * DAY_US))


@plan("subtract_buckets", f"""WITH {OBS_GAUGE}, {CUMULATIVE}
SELECT n.labels_key, n.day, n.bound, n.c - coalesce(o.c, 0) AS n FROM cum n LEFT JOIN cum o
    ON o.labels_key = n.labels_key AND o.bound = n.bound AND o.day = n.day - 1 WHERE n.c - coalesce(o.c, 0) > 0""")
def subtract_adjacent_days(spark, sf):
    now = cumulative_buckets(spark, sf)
    old = now.select(*SERIES, (F.col("slice") + 1).alias("slice"), F.col("buckets").alias("older"))
    both = now.join(old, [*SERIES, "slice"], "left")
    empty = F.array().cast("array<struct<bound:bigint,count:bigint>>")
    left = H.subtract_buckets(F.col("buckets"), F.coalesce(F.col("older"), empty))
    return (both.select("labels_key", F.col("slice").alias("day"), F.explode(left).alias("b"))
            .select("labels_key", "day", F.col("b.bound").alias("bound"), F.col("b.count").alias("n")))


@plan("windowed_distribution", f"""WITH {OBS_GAUGE}, {CUMULATIVE},
base AS (SELECT d.labels_key, d.day, max(o.day) AS base_day FROM days d LEFT JOIN days o
    ON o.labels_key = d.labels_key AND o.day <= d.day - 7 GROUP BY ALL),
tot AS (SELECT labels_key, day, CAST(sum(c) AS BIGINT) AS raw FROM cum GROUP BY ALL)
SELECT n.labels_key, n.day, t.raw, n.bound, n.c - coalesce(o.c, 0) AS n FROM cum n JOIN base b USING (labels_key, day)
    JOIN tot t USING (labels_key, day) LEFT JOIN cum o ON o.labels_key = n.labels_key AND o.bound = n.bound AND o.day = b.base_day
    WHERE n.c - coalesce(o.c, 0) > 0""")
def windowed_distribution(spark, sf):
    out = H.windowed_distribution(cumulative_buckets(spark, sf), "7 days", chunk="4 days")
    return (out.select("labels_key", F.floor(F.unix_micros("ts") / F.lit(DAY_US)).alias("day"), "raw", F.explode("buckets").alias("b"))
            .select("labels_key", "day", "raw", F.col("b.bound").alias("bound"), F.col("b.count").alias("n")))


@plan("windowed_distribution_thin", f"""WITH RECURSIVE {OBS_GAUGE}, {CUMULATIVE},
ordered AS (SELECT labels_key, day, row_number() OVER (PARTITION BY labels_key ORDER BY day) AS rn FROM days),
chain AS (SELECT labels_key, rn, day, day AS last FROM ordered WHERE rn = 1 UNION ALL
    SELECT o.labels_key, o.rn, o.day, CASE WHEN o.day - c.last >= 2 THEN o.day ELSE c.last END FROM chain c
    JOIN ordered o ON o.labels_key = c.labels_key AND o.rn = c.rn + 1),
kept AS (SELECT DISTINCT labels_key, last AS day FROM chain),
base AS (SELECT d.labels_key, d.day, max(o.day) AS base_day FROM days d LEFT JOIN kept o
    ON o.labels_key = d.labels_key AND o.day <= d.day - 16 GROUP BY ALL)
SELECT n.labels_key, n.day, n.bound, n.c - coalesce(o.c, 0) AS n FROM cum n JOIN base b USING (labels_key, day)
    LEFT JOIN cum o ON o.labels_key = n.labels_key AND o.bound = n.bound AND o.day = b.base_day
    WHERE n.c - coalesce(o.c, 0) > 0""")
def windowed_distribution_thin(spark, sf):
    out = H.windowed_distribution(cumulative_buckets(spark, sf), "16 days", thin=True, chunk="4 days")
    return (out.select("labels_key", F.floor(F.unix_micros("ts") / F.lit(DAY_US)).alias("day"), F.explode("buckets").alias("b"))
            .select("labels_key", "day", F.col("b.bound").alias("bound"), F.col("b.count").alias("n")))


AS_OF = "2024-01-30 12:00:00"


@plan("expire_stale", f"""WITH {OBS_GAUGE},
l AS (SELECT user_id, max(us) AS last, count(*) AS n FROM obs GROUP BY ALL)
SELECT user_id, CASE WHEN epoch_us(TIMESTAMP '{AS_OF}') - last > {36 * HOUR_US} THEN 0 ELSE n END AS live FROM l""")
def expire_stale(spark, sf):
    obs = obs_gauge(spark, sf)
    last = obs.groupBy("user_id").agg(F.max("ts").alias("last_update"))
    rows = H.bucket_array(H.slice_histogram(obs, "36500 days", keys=["user_id"]), ["user_id"]).join(last, "user_id")
    out = H.expire_stale(rows, AS_OF, "12 hours", "1 hour")
    return out.select("user_id", event_total("buckets").cast("bigint").alias("live"))


@plan("event_totals", f"""WITH {OBS_GAUGE} SELECT event_type, us // {DAY_US} AS day, count(*) AS n FROM obs GROUP BY ALL""")
def event_totals(spark, sf):
    arrays = H.bucket_array(H.slice_histogram(obs_gauge(spark, sf), "1 day", keys=["event_type"]), ["event_type", "slice"])
    return arrays.select("event_type", F.col("slice").alias("day"), event_total("buckets").cast("bigint").alias("n"))


@plan("latest_snapshot", f"""WITH {OBS_GAUGE}, w AS (SELECT * FROM obs WHERE us <= epoch_us(TIMESTAMP '2024-01-15')),
b AS (SELECT labels_key, {bound_sql('raw')} AS bound, count(*) AS c FROM w
    WHERE us // {HOUR_US} BETWEEN epoch_us(TIMESTAMP '2024-01-15') // {HOUR_US} - 24 AND epoch_us(TIMESTAMP '2024-01-15') // {HOUR_US} - 1 GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER (PARTITION BY labels_key ORDER BY bound) AS cum, sum(c) OVER (PARTITION BY labels_key) AS n FROM b),
p AS (SELECT labels_key, {percentiles_sql()} FROM cm GROUP BY labels_key)
SELECT w.labels_key, arg_max(w.raw, w.us) AS raw, max(w.us) AS last_us, any_value(p.p50) AS p50, any_value(p.p99) AS p99
FROM w LEFT JOIN p USING (labels_key) GROUP BY w.labels_key""")
def latest_snapshot_with_window(spark, sf):
    at = "2024-01-15 00:00:00"
    obs = obs_gauge(spark, sf)
    now = latest_snapshot(obs, at)
    end = F.unix_micros(F.lit(at).cast("timestamp"))
    recent = obs.where((F.unix_micros("ts") < end) & (F.unix_micros("ts") >= end - 24 * HOUR_US))
    windows = H.rollup_row(H.bucket_array(H.slice_histogram(recent, "36500 days"), list(SERIES)))
    return now.join(windows, list(SERIES), "left").select(
        "labels_key", "raw", F.unix_micros("last_update").alias("last_us"), "p50", "p99")
