"""Queries for the rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import diagnostics as D
from fleetpulse.operators.rates import queue_delta
from fleetpulse.operators.rollups import queue_cv
from fleetpulse.plans.adapters import CENTS, DAY_US, HOUR_US, QUEUE_OBS, cents, events, queue_obs, round_sql, table
from fleetpulse.plans.registry import plan


def host_days(spark, sf):
    """Per host and day one feature from each event type."""
    us = F.unix_micros("ts")
    return (events(spark, sf).groupBy((F.col("user_id") % 10).alias("host"), F.floor(us / F.lit(DAY_US)).alias("day"))
            .agg(*[F.sum(F.when(F.col("event_type") == t, cents()).otherwise(F.lit(0))).alias(t)
                   for t in ("view", "click", "purchase", "signup", "error")]))


_HOST_DAYS = "hd AS (SELECT user_id % 10 AS host, epoch_us(ts) // " + str(DAY_US) + " AS day, " + ", ".join(
    f"CAST(sum(CASE WHEN event_type = '{t}' THEN {CENTS} ELSE 0 END) AS BIGINT) AS \"{t}\""
    for t in ("view", "click", "purchase", "signup", "error")) + " FROM events GROUP BY ALL)"


@plan("receive_ceiling", f"""WITH {_HOST_DAYS}, f AS (SELECT host, day, view % 4 = 0 AS drops, view % 100 AS cv, click AS hottest, purchase AS peers,
    signup * 208.0 / nullif(error * 1000.0, 0) * 1e6 / 1000 AS rtt, (view % 10) / 10.0 AS softirq FROM hd)
SELECT host, day, CASE WHEN drops THEN 'ring_buffer' WHEN cv > 30 AND hottest > peers * 2 THEN 'rss_imbalance'
WHEN rtt BETWEEN 100 AND 2000 THEN 'socket_buffer' WHEN softirq > 0.5 THEN 'mtu_overhead' ELSE 'none' END AS verdict FROM f""")
def receive_ceiling(spark, sf):
    rows = host_days(spark, sf).select(
        "host", "day", F.when(F.col("view") % 4 == 0, 1).otherwise(0).alias("ring_drops"), (F.col("view") % 100).alias("rss_cv"),
        F.col("click").alias("hottest"), F.col("purchase").alias("peer_mean"), F.col("signup").alias("connections"),
        F.lit(208).alias("rmem_max"), (F.col("error") * 1_000_000).alias("throughput"), (F.col("view") % 10 / F.lit(10.0)).alias("softirq"))
    return D.receive_ceiling(rows).select("host", "day", "verdict")


@plan("rss_tier", f"""WITH {QUEUE_OBS}, l AS (SELECT *, lag(value) OVER (PARTITION BY iface, queue ORDER BY tick) AS pv FROM queues),
d AS (SELECT iface, tick, greatest(value - pv, 0) AS delta FROM l WHERE pv IS NOT NULL),
g AS (SELECT iface, tick, count(*) AS q, sum(delta) AS s, sum(delta * delta) AS ss FROM d GROUP BY ALL),
c AS (SELECT iface, tick, CASE WHEN q >= 2 AND s >= q THEN CAST(floor(sqrt(CAST(q * ss - s * s AS DOUBLE)) / s * 100) AS BIGINT) END AS cv FROM g)
SELECT iface, tick, CASE WHEN cv > 50 THEN 'severe' WHEN cv > 30 THEN 'elevated' ELSE 'balanced' END AS tier FROM c""")
def rss_tier(spark, sf):
    cv = queue_cv(queue_delta(queue_obs(spark, sf), tick="tick", chunk=24), ["iface", "tick"])
    return cv.select("iface", "tick", D.rss_tier("rss_cv").alias("tier"))


_ERRORS = ("timeout", "io", "target", "requeue", "unsupported", "nospc", "protection")


def io_errors(spark, sf):
    """Errors of 40 hosts; the rarer classes only occur on some hosts."""
    n = F.col("user_id") % 40
    pick = F.when(n % 7 == 0, F.lit(6)).when(n % 5 == 0, F.lit(5)).otherwise((F.col("event_id") % (F.col("user_id") % 4 + 2)))
    error = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (pick + 1).cast("int"))
    third = F.floor(F.unix_micros("ts") / F.lit(10 * DAY_US))
    return events(spark, sf).select(n.alias("host"), third.alias("bucket"), error.alias("error"), (cents() % 100).alias("count"))


_KINDS = ("timeout", "io", "target", "nospc", "protection", "unsupported", "requeue")
_TREND = ("timeout", "io", "unsupported", "requeue", "errors")


def _up(m: str, f: str = "1.5") -> str:
    return f"(coalesce({m}_last, 0) > coalesce({m}_first, 0) * {f} AND coalesce({m}_last, 0) > 0)"


@plan("io_error_mix", f"""WITH e AS (SELECT user_id % 40 AS host, epoch_us(ts) // {10 * DAY_US} AS bucket, {CENTS} % 100 AS count,
    [{', '.join(f"'{e}'" for e in _ERRORS)}][CAST(CASE WHEN user_id % 40 % 7 = 0 THEN 6 WHEN user_id % 40 % 5 = 0 THEN 5 ELSE event_id % (user_id % 4 + 2) END AS INT) + 1] AS error FROM events),
c AS (SELECT host, bucket, {', '.join(f"CAST(sum(CASE WHEN error = '{k}' THEN count ELSE 0 END) AS BIGINT) AS {k}" for k in _KINDS)},
    CAST(sum(CASE WHEN error <> 'requeue' THEN count ELSE 0 END) AS BIGINT) AS errors FROM e GROUP BY ALL),
t AS (SELECT host, {', '.join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in (*_KINDS, 'errors'))}, {', '.join(f"arg_min({m}, bucket) AS {m}_first, arg_max({m}, bucket) AS {m}_last" for m in _TREND)} FROM c GROUP BY host),
s AS (SELECT *, io / nullif(errors, 0) AS io_s, target / nullif(errors, 0) AS target_s FROM t)
SELECT host, {', '.join(_KINDS)}, errors, {round_sql('io_s', 4)} AS io_share, {round_sql('target_s', 4)} AS target_share,
CASE WHEN protection > 0 THEN 'data_integrity' WHEN nospc > 0 THEN 'thin_pool_full' WHEN {_up('requeue')} AND {_up('errors')} THEN 'recovery_exhausted'
WHEN {_up('requeue')} THEN 'flaky_path' WHEN io_s >= 0.2 AND target_s >= 0.2 THEN 'device_failure' WHEN {_up('timeout')} AND NOT {_up('io')} THEN 'transport_blackhole'
WHEN {_up('unsupported')} THEN 'configuration_drift' ELSE 'none' END AS verdict FROM s""")
def io_error_mix(spark, sf):
    return D.io_error_mix(io_errors(spark, sf))


@plan("cpu_contention", f"""WITH {_HOST_DAYS} SELECT host, day, CASE WHEN view > 20000 AND click > 20000 THEN 'host_oversubscribed' WHEN view > 20000 THEN 'self_induced'
WHEN click > 20000 THEN 'hypervisor_preemption' ELSE 'none' END AS verdict FROM hd""")
def cpu_contention(spark, sf):
    return D.cpu_contention(host_days(spark, sf), "view", "click", 20000, 20000).select("host", "day", "verdict")


@plan("throttle_vs_contention", f"""WITH {_HOST_DAYS} SELECT host, day, CASE WHEN error > 15000 AND view > 20000 THEN 'both' WHEN error > 15000 THEN 'quota'
WHEN view > 20000 THEN 'contention' ELSE 'none' END AS verdict FROM hd""")
def throttle_vs_contention(spark, sf):
    return D.throttle_vs_contention(host_days(spark, sf), "error", "view", 15000, 20000).select("host", "day", "verdict")


def _islands_sql(flag: str, value: str) -> str:
    return f"""h AS (SELECT user_id % 10 AS host, epoch_us(ts) AS us, event_id, {value} AS value FROM events),
f AS (SELECT *, coalesce({flag}, false) AS flagged FROM h),
l AS (SELECT *, lag(flagged) OVER (PARTITION BY host ORDER BY us, event_id) AS before FROM f),
i AS (SELECT *, sum(CASE WHEN flagged AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY us, event_id) AS island FROM l),
g AS (SELECT host, island, min(us) AS start_us, max(us) AS end_us, count(*) AS readings, max(value) AS peak FROM i WHERE flagged GROUP BY host, island)"""


@plan("loss_detection", f"WITH {_islands_sql('value > 0', f'greatest({CENTS} - 2000, 0)')} SELECT host, start_us, end_us, readings, peak AS severity, 'loss' AS verdict FROM g")
def loss_detection(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 10).alias("host"), "ts", "event_id", F.greatest(cents() - 2000, F.lit(0)).alias("p99"))
    out = D.loss_detection(rows, order=["ts", "event_id"], chunk="2 days")
    return out.select("host", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "readings", "severity", "verdict")


@plan("burst_windows", f"""WITH {_islands_sql('value > 1500', CENTS)} SELECT host, start_us, end_us, readings, peak, end_us - start_us AS length_us,
CASE WHEN end_us - start_us < {HOUR_US} THEN 'blip' WHEN end_us - start_us <= {4 * HOUR_US} THEN 'burst' ELSE 'sustained' END AS verdict FROM g""")
def burst_windows(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 10).alias("host"), "ts", "event_id", cents().alias("steal"))
    out = D.burst_windows(rows, threshold=1500, min_length="1 hour", max_length="4 hours", order=["ts", "event_id"], chunk="2 days")
    return out.select("host", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "readings", "peak", "length_us", "verdict")


@plan("retransmit_shape", f"""WITH {_HOST_DAYS}, s AS (SELECT host, corr(error, error + view / 10.0 * (host % 3)) AS c, max(error) AS peak, avg(error) AS mean, stddev_pop(error) AS sd,
    avg(CASE WHEN error > 15000 THEN 1.0 ELSE 0.0 END) AS share FROM hd GROUP BY host)
SELECT host, peak, {round_sql('c', 6)} AS corr, {round_sql('share', 6)} AS share, CASE WHEN peak = 0 THEN 'clean' WHEN c >= 0.95 THEN 'scales_with_traffic' WHEN share >= 0.5 THEN 'sustained_under_load'
WHEN (peak - mean) / nullif(sd, 0) >= 2.5 THEN 'spike_independent_of_load' ELSE 'background' END AS verdict FROM s""")
def retransmit_shape(spark, sf):
    rows = host_days(spark, sf).withColumn("bytes", F.col("error") + F.col("view") / F.lit(10.0) * (F.col("host") % 3))
    out = D.retransmit_shape(rows, retrans="error", correlation=0.95, spike=2.5, elevated=15000)
    return out.select("host", F.col("peak").cast("bigint").alias("peak"), F.round("corr", 6).alias("corr"),
                      F.round("elevated_share", 6).alias("share"), "verdict")


_MTU_AT = f"1704067200000000 + s_suppkey * {7 * HOUR_US}"


@plan("mtu_regression", f"""WITH m AS (SELECT user_id % 10 AS host, epoch_us(ts) AS us, CASE WHEN event_id % 2 = 0 THEN 'tcp_retrans_segs' ELSE 'network_transmit_bytes' END AS name, {CENTS} AS v FROM events),
c AS (SELECT s_suppkey % 10 AS host, {_MTU_AT} AS at_us, CASE WHEN s_suppkey % 3 = 0 THEN 'ring.eth0.rx' ELSE 'mtu.eth' || s_suppkey END AS key FROM supplier),
j AS (SELECT c.host, at_us, key, name, us < at_us AS prior, v FROM c JOIN m ON m.host = c.host AND us BETWEEN at_us - {24 * HOUR_US} AND at_us + {24 * HOUR_US} WHERE starts_with(key, 'mtu.')),
s AS (SELECT host, at_us, key, name, avg(CASE WHEN NOT prior THEN v END) - avg(CASE WHEN prior THEN v END) AS delta FROM j GROUP BY ALL),
p AS (SELECT host, at_us, key, max(CASE WHEN name = 'tcp_retrans_segs' THEN delta END) AS r, max(CASE WHEN name = 'network_transmit_bytes' THEN delta END) AS t FROM s GROUP BY ALL)
SELECT host, at_us, key, {round_sql('r', 4)} AS retrans_delta, {round_sql('t', 4)} AS throughput_delta,
CASE WHEN r > 0 AND t < 0 THEN 'path_mtu' WHEN r > 0 THEN 'retransmits_up' WHEN t < 0 THEN 'throughput_down' ELSE 'none' END AS verdict FROM p""")
def mtu_regression(spark, sf):
    rows = events(spark, sf).select(
        (F.col("user_id") % 10).alias("host"), "ts", cents().alias("p99"),
        F.when(F.col("event_id") % 2 == 0, "tcp_retrans_segs").otherwise("network_transmit_bytes").alias("name"))
    k = F.col("s_suppkey")
    changes = table(spark, sf, "supplier").select(
        (k % 10).alias("host"), F.timestamp_micros(F.lit(1704067200000000) + k * (7 * HOUR_US)).alias("change_ts"),
        F.when(k % 3 == 0, F.lit("ring.eth0.rx")).otherwise(F.concat(F.lit("mtu.eth"), k.cast("string"))).alias("key"))
    out = D.mtu_regression(rows, changes, before="24 hours", after="24 hours")
    return out.select("host", F.unix_micros("change_ts").alias("at_us"), "key", F.round("retrans_delta", 4).alias("retrans_delta"),
                      F.round("throughput_delta", 4).alias("throughput_delta"), "verdict")


@plan("fragment_failure", f"""WITH b AS (SELECT user_id % 60 AS family, epoch_us(ts) // {10 * DAY_US} AS bucket, avg({CENTS}) AS requests, avg({CENTS} % 50) AS ok, avg({CENTS} % 70) AS failures FROM events GROUP BY ALL),
t AS (SELECT family, {', '.join(f"arg_min({m}, bucket) AS {m}_first, arg_max({m}, bucket) AS {m}_last" for m in ('requests', 'ok', 'failures'))} FROM b GROUP BY family)
SELECT family, CASE WHEN {_up('requests', '1.05')} AND NOT {_up('ok', '1.05')} AND {_up('failures', '1.05')} THEN 'reassembly_failure' WHEN {_up('failures', '1.05')} THEN 'failures_rising' ELSE 'none' END AS verdict FROM t""")
def fragment_failure(spark, sf):
    rows = events(spark, sf).select(
        (F.col("user_id") % 60).alias("family"), F.floor(F.unix_micros("ts") / F.lit(10 * DAY_US)).alias("bucket"),
        cents().alias("requests"), (cents() % 50).alias("ok"), (cents() % 70).alias("failures"))
    return D.fragment_failure(rows, factor=1.05).select("family", "verdict")


@plan("offcpu_class", f"""WITH {_HOST_DAYS} SELECT host, day, {round_sql('view * 40000.0 / 1e9', 6)} AS offcpu_seconds, CASE WHEN view * 40000.0 / 1e9 <= 0.5 THEN 'none' WHEN error % 3 = 0 AND error > 0 THEN 'quota'
WHEN click / 1e6 > 0.03 THEN 'host_preemption' WHEN purchase / 1e5 < 0.2 THEN 'io_or_lock_bound' ELSE 'self_induced' END AS verdict FROM hd""")
def offcpu_class(spark, sf):
    rows = host_days(spark, sf).select(
        "host", "day", (F.col("view") * 40000).alias("offcpu_ns_rate"), (F.col("purchase") / F.lit(1e5)).alias("cpu_usage"),
        F.when(F.col("error") % 3 == 0, F.col("error")).otherwise(F.lit(0)).alias("throttled"), (F.col("click") / F.lit(1e6)).alias("steal"))
    out = D.offcpu_class(rows, cpu_limit=0.2, steal_limit=0.03)
    return out.select("host", "day", F.round("offcpu_seconds", 6).alias("offcpu_seconds"), "verdict")


@plan("hot_entity", f"""WITH {QUEUE_OBS}, p AS (SELECT *, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS peer_mean FROM queues WINDOW w AS (PARTITION BY iface, tick))
SELECT iface, tick, queue, value, {round_sql('peer_mean', 4)} AS peer_mean, 'hot' AS verdict FROM p WHERE value > 0 AND value >= peer_mean * 1.3""")
def hot_entity(spark, sf):
    out = D.hot_entity(queue_obs(spark, sf), ["iface", "tick"], factor=1.3)
    return out.select("iface", "tick", "queue", "value", F.round("peer_mean", 4).alias("peer_mean"), "verdict")
