"""Rule-based verdicts over roll-ups. Every threshold is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.durations import micros
from fleetpulse.operators.chunks import DEFAULT_CHUNK, last_known, with_previous
from fleetpulse.operators.joins import before_after


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(c) -> Column:
    return F.coalesce(_col(c).cast("double"), F.lit(0.0))


def rising(first, last, factor: float = 1.5) -> Column:
    """The last bucket's mean exceeds ``factor`` times the first bucket's, and zero."""
    return (_num(last) > _num(first) * F.lit(factor)) & (_num(last) > F.lit(0.0))


def first_last(df: DataFrame, keys: Sequence[str], bucket: str, metrics: Sequence[str]) -> DataFrame:
    """Per key the mean of every metric in its first and last time bucket."""
    means = df.groupBy(*keys, bucket).agg(*[F.avg(m).alias(m) for m in metrics])
    row = F.struct(*metrics)
    ends = means.groupBy(*keys).agg(F.min_by(row, bucket).alias("f"), F.max_by(row, bucket).alias("l"))
    return ends.select(*keys, *[F.col(f"f.{m}").alias(f"{m}_first") for m in metrics],
                       *[F.col(f"l.{m}").alias(f"{m}_last") for m in metrics])


def rss_tier(cv, severe: float = 50, elevated: float = 30) -> Column:
    cv = _col(cv)
    return F.when(cv > severe, "severe").when(cv > elevated, "elevated").otherwise("balanced")


def receive_ceiling(df: DataFrame, cv_limit: float = 30, hot_factor: float = 2, rtt_low_us: float = 100,
                    rtt_high_us: float = 2000, softirq_limit: float = 0.5) -> DataFrame:
    """Why receive throughput is stuck, one row per input row, the first cause that fits.

    Features: ring_drops, rss_cv, hottest, peer_mean, connections, rmem_max,
    throughput (bytes/s), softirq (busy share of the busiest CPU).
    """
    rtt = _num("connections") * _num("rmem_max") / F.nullif(_num("throughput"), F.lit(0.0)) * F.lit(1e6)
    verdict = (F.when(_num("ring_drops") > 0, "ring_buffer")
               .when((_num("rss_cv") > cv_limit) & (_num("hottest") > _num("peer_mean") * hot_factor), "rss_imbalance")
               .when((rtt >= rtt_low_us) & (rtt <= rtt_high_us), "socket_buffer")
               .when(_num("softirq") > softirq_limit, "mtu_overhead")
               .otherwise("none"))
    return df.withColumn("implied_rtt_us", rtt).withColumn("verdict", verdict)


def io_error_mix(df: DataFrame, keys: Sequence[str] = ("host",), bucket: str = "bucket", factor: float = 1.5,
                 device_share: float = 0.2) -> DataFrame:
    """The pattern in (keys, bucket, error, count) rows; requeues are rows with error 'requeue'."""
    kinds = ("timeout", "io", "target", "nospc", "protection", "unsupported", "requeue")
    cells = df.groupBy(*keys, bucket).agg(*[
        F.sum(F.when(F.col("error") == k, F.col("count")).otherwise(F.lit(0))).alias(k) for k in kinds],
        F.sum(F.when(F.col("error") != "requeue", F.col("count")).otherwise(F.lit(0))).alias("errors"))
    trend = first_last(cells, keys, bucket, ["timeout", "io", "unsupported", "requeue", "errors"])
    total = cells.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in (*kinds, "errors")])
    both = total.join(trend, list(keys))

    def up(name):
        return rising(f"{name}_first", f"{name}_last", factor)

    def share(name):
        return _num(name) / F.nullif(_num("errors"), F.lit(0.0))

    verdict = (F.when(F.col("protection") > 0, "data_integrity")
               .when(F.col("nospc") > 0, "thin_pool_full")
               .when(up("requeue") & up("errors"), "recovery_exhausted")
               .when(up("requeue"), "flaky_path")
               .when((share("io") >= device_share) & (share("target") >= device_share), "device_failure")
               .when(up("timeout") & ~up("io"), "transport_blackhole")
               .when(up("unsupported"), "configuration_drift")
               .otherwise("none"))
    return both.select(*keys, *kinds, "errors", F.round(share("io"), 4).alias("io_share"),
                       F.round(share("target"), 4).alias("target_share"), verdict.alias("verdict"))


def cpu_contention(df: DataFrame, wait: str = "runqueue_wait", steal: str = "steal", wait_limit: float = 0.1,
                   steal_limit: float = 0.05) -> DataFrame:
    high_wait, high_steal = _num(wait) > wait_limit, _num(steal) > steal_limit
    return df.withColumn("verdict", F.when(high_wait & high_steal, "host_oversubscribed")
                         .when(high_wait, "self_induced").when(high_steal, "hypervisor_preemption")
                         .otherwise("none"))


def throttle_vs_contention(df: DataFrame, throttled: str = "throttled", wait: str = "runqueue_wait",
                           throttle_limit: float = 0, wait_limit: float = 0.1) -> DataFrame:
    quota, contended = _num(throttled) > throttle_limit, _num(wait) > wait_limit
    return df.withColumn("verdict", F.when(quota & contended, "both").when(quota, "quota")
                         .when(contended, "contention").otherwise("none"))


def _islands(df: DataFrame, keys: Sequence[str], flag: Column, order: Sequence[str], chunk) -> DataFrame:
    """Rows where ``flag`` holds, with ``__island``: the time their uninterrupted run began."""
    marked = df.withColumn("__on", F.coalesce(flag, F.lit(False)))
    marked = with_previous(marked, keys, order, {"__before": "__on"}, chunk)
    opens = F.col("__on") & ~F.coalesce(F.col("__before"), F.lit(False))
    marked = marked.withColumn("__island", F.when(opens, F.struct(*order)))
    return last_known(marked, keys, order, "__island", chunk).where("__on")


def loss_detection(df: DataFrame, keys: Sequence[str] = ("host",), rate: str = "p99", order: Sequence[str] = ("ts",),
                   chunk=DEFAULT_CHUNK) -> DataFrame:
    """Windows of packet loss from the retransmitted-segments rate (never from round-trip times)."""
    lossy = _islands(df, keys, F.col(rate) > 0, order, chunk)
    return (lossy.groupBy(*keys, "__island")
            .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("readings"),
                 F.max(rate).alias("severity"))
            .drop("__island").withColumn("verdict", F.lit("loss")))


def burst_windows(df: DataFrame, keys: Sequence[str] = ("host",), value: str = "steal", threshold: float = 0.05,
                  min_length="1 s", max_length="120 s", order: Sequence[str] = ("ts",), chunk=DEFAULT_CHUNK) -> DataFrame:
    """Short runs above the threshold that end abruptly; long ones are sustained contention."""
    high = _islands(df, keys, F.col(value) > threshold, order, chunk)
    length = F.unix_micros("end") - F.unix_micros("start")
    return (high.groupBy(*keys, "__island")
            .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("readings"),
                 F.max(value).alias("peak"))
            .drop("__island").withColumn("length_us", length)
            .withColumn("verdict", F.when(length < micros(min_length), "blip")
                        .when(length <= micros(max_length), "burst").otherwise("sustained")))


def retransmit_shape(df: DataFrame, keys: Sequence[str] = ("host",), retrans: str = "retrans", traffic: str = "bytes",
                     correlation: float = 0.7, spike: float = 4, sustained_share: float = 0.5,
                     elevated: float = 1.0) -> DataFrame:
    """How retransmits relate to load, per key (one row of ``df`` per time bucket)."""
    r, b = _num(retrans), _num(traffic)
    stats = df.groupBy(*keys).agg(
        F.corr(r, b).alias("corr"), F.max(r).alias("peak"), F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("sd"), F.avg((r > elevated).cast("double")).alias("elevated_share"))
    z = (F.col("peak") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    steady = F.coalesce(F.col("corr") >= correlation, F.lit(False))
    verdict = (F.when(F.col("peak") == 0, "clean").when(steady, "scales_with_traffic")
               .when(F.col("elevated_share") >= sustained_share, "sustained_under_load")
               .when(z >= spike, "spike_independent_of_load").otherwise("background"))
    return stats.withColumn("z", z).withColumn("verdict", verdict)


def mtu_regression(df: DataFrame, changes: DataFrame, keys: Sequence[str] = ("host",), before="120 s", after="120 s",
                   retrans: str = "tcp_retrans_segs", throughput: str = "network_transmit_bytes",
                   value: str = "p99", change_ts: str = "change_ts") -> DataFrame:
    """After an ``mtu.*`` change: retransmits up and throughput down point at the path MTU."""
    mtu = changes.where(F.startswith("key", F.lit("mtu.")))
    rows = df.where(F.col("name").isin(retrans, throughput))
    sides = before_after(rows, mtu, before, after, value, keys, (change_ts, "key"), ("name",), change_ts)
    pair = sides.groupBy(*keys, change_ts, "key").agg(*[
        F.max(F.when(F.col("name") == n, F.col("delta"))).alias(a)
        for n, a in ((retrans, "retrans_delta"), (throughput, "throughput_delta"))])
    worse, slower = F.col("retrans_delta") > 0, F.col("throughput_delta") < 0
    return pair.withColumn("verdict", F.when(worse & slower, "path_mtu").when(worse, "retransmits_up")
                           .when(slower, "throughput_down").otherwise("none"))


def fragment_failure(df: DataFrame, keys: Sequence[str] = ("family",), bucket: str = "bucket",
                     factor: float = 1.5) -> DataFrame:
    """Reassembly requests and failures rising while successes stay flat (columns requests, ok, failures)."""
    trend = first_last(df, keys, bucket, ["requests", "ok", "failures"])

    def up(name):
        return rising(f"{name}_first", f"{name}_last", factor)

    return trend.withColumn("verdict", F.when(up("requests") & ~up("ok") & up("failures"), "reassembly_failure")
                            .when(up("failures"), "failures_rising").otherwise("none"))


def offcpu_class(df: DataFrame, offcpu: str = "offcpu_ns_rate", cpu: str = "cpu_usage", throttled: str = "throttled",
                 steal: str = "steal", offcpu_limit: float = 0.5, cpu_limit: float = 0.3,
                 steal_limit: float = 0.05) -> DataFrame:
    """What keeps a group off the CPU; the rate becomes blocked seconds per second."""
    seconds = _num(offcpu) / F.lit(1e9)
    high = seconds > offcpu_limit
    return df.withColumn("offcpu_seconds", seconds).withColumn(
        "verdict", F.when(~high, "none").when(_num(throttled) > 0, "quota")
        .when(_num(steal) > steal_limit, "host_preemption").when(_num(cpu) < cpu_limit, "io_or_lock_bound")
        .otherwise("self_induced"))


def hot_entity(df: DataFrame, tick: Sequence[str] = ("ts",), entity: str = "queue", value: str = "value",
               factor: float = 2) -> DataFrame:
    """Entities carrying at least ``factor`` times the mean of their peers in the same tick.

    Sums per tick are aggregated first, so a tick with many entities is never one task.
    """
    tick = list(tick)
    sums = df.groupBy(*tick).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    peers = (F.col("__sum") - F.col(value)).cast("double") / F.nullif((F.col("__n") - 1).cast("double"), F.lit(0.0))
    rated = df.join(sums, tick).withColumn("peer_mean", peers)
    return (rated.where((F.col(value) > 0) & (F.col(value).cast("double") >= F.col("peer_mean") * F.lit(float(factor))))
            .drop("__sum", "__n").withColumn("verdict", F.lit("hot")))
