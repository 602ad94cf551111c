"""Scalar rules for ports, queues, units and measurement artifacts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two bounds at which a saturated histogram pins its tail.
SATURATED_BOUNDS = (2**39 - 1, 2**20 - 1)

# Per-queue statistics, by direction.
QUEUE_STATS = {
    "rx": ("packets", "bytes", "dropped", "buff_alloc_err"),
    "tx": ("packets", "bytes", "dropped"),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_gbps(bytes_per_second, digits: int | None = 2) -> Column:
    """Bytes per second as gigabits per second."""
    gbps = _col(bytes_per_second).cast("double") / F.lit(1.25e8)
    return gbps if digits is None else F.round(gbps, digits)


def kib_to_bytes(c) -> Column:
    return _col(c) * F.lit(1024)


def sectors_to_bytes(c) -> Column:
    return _col(c) * F.lit(512)


def fixed_point(c) -> Column:
    """A fraction as hundredths, rounded half away from zero."""
    return F.round(_col(c).cast("double") * F.lit(100.0)).cast("bigint")


def megabytes(c) -> Column:
    return _col(c).cast("double") / F.lit(1e6)


def ns_to_us(c) -> Column:
    v = _col(c)
    return F.floor(v / F.lit(1000)).cast("bigint")


def service_port(sport, dport, floor: int = 32768) -> Column:
    """The well-known side of a connection; the lower port if both are, null if neither is."""
    s, d = _col(sport), _col(dport)
    known_s, known_d = s < F.lit(floor), d < F.lit(floor)
    return (F.when(known_s & known_d, F.least(s, d))
            .when(known_s, s)
            .when(known_d, d))


def queue_stat_fields(stat_name) -> Column:
    """``struct(direction, queue, metric)`` of a per-queue driver statistic, else null."""
    name = _col(stat_name)
    pattern = "|".join(
        rf"{d}(?:_queue_)?\d+_(?:{'|'.join(stats)})" for d, stats in QUEUE_STATS.items())
    hit = name.rlike(f"^(?:{pattern})$")
    parts = r"^(rx|tx)(?:_queue_)?(\d+)_(.*)$"
    direction, stat = F.regexp_extract(name, parts, 1), F.regexp_extract(name, parts, 3)
    return F.when(hit, F.struct(
        direction.alias("direction"),
        F.regexp_extract(name, parts, 2).try_cast("int").alias("queue"),
        F.concat(F.lit("nic/queue/"), direction, F.lit("_"), stat).alias("metric")))


def artifact_flags(p50, p99, line_rate) -> Column:
    """What an implausible p99 means: saturation, aliasing or the ordinary tail overshoot."""
    p99, rate = F.greatest(_col(p99), _col(p50)), _col(line_rate)
    return (F.when(p99.isin(*SATURATED_BOUNDS), F.lit("saturated"))
            .when(p99 > rate * F.lit(1.5), F.lit("aliasing"))
            .when(p99 > rate, F.lit("tail_artifact"))
            .otherwise(F.lit("ok")))
