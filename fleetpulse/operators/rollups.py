"""Queries over the roll-up table ``samples`` and over recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fleetpulse.durations import micros
from fleetpulse.functions.network import service_port, to_gbps
from fleetpulse.functions.text import encode_labels
from fleetpulse.operators.chunks import running_total, with_previous
from fleetpulse.operators.filters import label_filter, name_filter
from fleetpulse.operators.rates import entity_delta, irate
from fleetpulse.schema import SERIES

RX, TX = "network_receive_bytes", "network_transmit_bytes"


def tag(key: str, tags: str = "tags"):
    return F.try_element_at(tags, F.lit(key))


def pivot_percentiles(df: DataFrame, names: dict[str, str], columns: Sequence[str], fill=0,
                      by: Sequence[str] = ("ts",), scale=None) -> DataFrame:
    """One row per ``by`` with ``{prefix}_{column}`` = the highest value of that metric.

    ``names`` maps output prefix to metric name; a metric absent from a group gives ``fill``.
    """
    scale = scale or (lambda c: c)
    cells = []
    for prefix, name in names.items():
        for column in columns:
            top = F.max(F.when(F.col("name") == name, F.col(column)))
            if fill is not None:
                top = F.coalesce(top, F.lit(fill))
            cells.append(scale(top).alias(f"{prefix}_{column}"))
    return name_filter(df, any_of=list(names.values())).groupBy(*by).agg(*cells)


def bandwidth(df: DataFrame, iface: str, direction: str = "both") -> DataFrame:
    """Percentiles in Gbps over time for one interface."""
    df = label_filter(df, {"iface": iface})
    if direction in ("rx", "tx"):
        rows = name_filter(df, equal=RX if direction == "rx" else TX)
        return rows.select(F.unix_millis("ts").alias("t_ms"), *[
            to_gbps(p).alias(f"{p}_gbps") for p in ("p50", "p90", "p99", "p999")]).orderBy("t_ms")
    return (pivot_percentiles(df.withColumn("t_ms", F.unix_millis("ts")), {"rx": RX, "tx": TX},
                              ("p50", "p99"), by=("t_ms",), scale=to_gbps).orderBy("t_ms"))


def queue_balance(df: DataFrame, iface: str | None = None, active: float = 0.01,
                  name: str = "nic_queue_rx_bytes", by: Sequence[str] = ()) -> DataFrame:
    """How evenly receive queues share the load: counts, extremes and spread of the active ones."""
    df = name_filter(df, equal=name)
    if iface is not None:
        df = label_filter(df, {"iface": iface})
    queues = (df.groupBy(*by, tag("queue").try_cast("int").alias("queue"))
              .agg(to_gbps(F.avg("p50"), None).alias("g")))
    busy = F.col("g") > F.lit(active)
    on = F.when(busy, F.col("g"))
    rate = F.stddev_pop(on) / F.nullif(F.avg(on), F.lit(0.0)) * F.lit(100.0)
    return queues.groupBy(*by).agg(
        F.count_if(busy).alias("active"), F.count_if(~busy).alias("idle"), F.count(F.lit(1)).alias("total"),
        F.round(F.coalesce(F.max(on), F.lit(0.0)), 2).alias("hottest_gbps"),
        F.round(F.coalesce(F.min(on), F.lit(0.0)), 2).alias("coldest_gbps"),
        F.round(rate, 1).alias("cv_pct"))


def expected_active(df: DataFrame, total: str = "total", flows: str = "flows") -> DataFrame:
    """Add how many of N queues F random flows are expected to reach."""
    n = F.col(total).cast("double")
    miss = F.pow((n - 1) / n, F.col(flows).cast("double"))
    return df.withColumn("expected_active", F.when(n > 0, n * (F.lit(1.0) - miss)).otherwise(F.lit(0.0)))


def busiest_cores(df: DataFrame, source: str = "procfs", top: int = 10) -> DataFrame:
    """Cores with the highest softirq p99; the all-CPU line and the other source are left out."""
    df = label_filter(df, {"source": "ebpf"}) if source == "ebpf" else label_filter(df, absent=["source"])
    df = label_filter(df, differ={"cpu": "cpu"}).withColumn("cpu", tag("cpu"))
    names = {s: f"cpu_usage_{s}" for s in ("softirq", "system", "user")}
    return (pivot_percentiles(df, names, ("p99",), by=("cpu",))
            .orderBy(F.desc("softirq_p99"), "cpu").limit(top))


def flow_health(df: DataFrame, names: Sequence[str] = ("tcp_rtt_us", "tcp_retransmits", "tcp_retrans_segs")) -> DataFrame:
    return (name_filter(df, any_of=names).groupBy("name")
            .agg(F.round(F.avg("p50"), 0).alias("avg_p50"), F.round(F.max("p99").cast("double"), 0).alias("max_p99"),
                 F.count(F.lit(1)).alias("samples")).orderBy("name"))


def metric_catalog(df: DataFrame, substring: str = "") -> DataFrame:
    """Per metric: rows and the label keys of its latest row (ties: the greatest key list)."""
    keys = F.array_sort(F.map_keys("tags"))
    return (name_filter(df, contains=substring).groupBy("name")
            .agg(F.count(F.lit(1)).alias("samples"), F.max_by(keys, F.struct("ts", keys)).alias("tag_keys"))
            .orderBy("name"))


def session_overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    identity = (*SERIES, "kind", "unit")
    series = F.xxhash64(*identity) if approximate else F.struct(*identity)
    return df.agg(F.count(F.lit(1)).alias("rows"), distinct(F.col("name")).alias("metrics"),
                  distinct(series).alias("series"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def label_facets(df: DataFrame, name: str, labels: str = "labels") -> DataFrame:
    """The label keys of a metric and their values, one row each: a key may have any number of values."""
    return (name_filter(df, equal=name).select(F.explode(labels).alias("label_key", "label_value"))
            .groupBy("label_key", "label_value").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy("label_key", "label_value"))


def kind_unit_shapes(df: DataFrame, name: str | None = None) -> DataFrame:
    if name is not None:
        df = name_filter(df, equal=name)
    return (df.select("name", "kind", "unit").distinct()
            .withColumn("caption", F.upper(F.concat("kind", F.lit(" · "), "unit"))))


def queue_cv(df: DataFrame, keys: Sequence[str] = ("iface", "ts"), delta: str = "delta") -> DataFrame:
    """Spread of per-queue deltas per tick, in percent of the mean, truncated.

    Null below two queues or a mean of one. Sums of integers instead of a mean
    of squares keep the result independent of row order.
    """
    d = F.col(delta).cast("decimal(38,0)")
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("queues"), F.sum(d).alias("__s"),
                                 F.sum((d * d).cast("decimal(38,0)")).alias("__q"))
    n = F.col("queues").cast("decimal(20,0)")
    # n^2 * variance, exact
    spread = (n * F.col("__q")).cast("decimal(38,0)") - (F.col("__s") * F.col("__s")).cast("decimal(38,0)")
    cv = F.sqrt(spread.cast("double")) / F.col("__s").cast("double")
    usable = (F.col("queues") >= 2) & (F.col("__s") >= F.col("queues"))
    return (sums.withColumn("cv", F.when(usable, cv))
            .withColumn("rss_cv", F.floor(F.col("cv") * F.lit(100.0)).cast("bigint")).drop("__s", "__q"))


def sum_over_label(df: DataFrame, label: str, labels: str = "labels", value: str = "raw",
                   by: Sequence[str] = ("ts", "name")) -> DataFrame:
    """Collapse one label; the others still separate series."""
    rest = F.map_filter(labels, lambda k, v: k != F.lit(label))
    return (df.groupBy(*by, encode_labels(rest).alias("labels_key"))
            .agg(F.sum(value).alias(value)))


def panel_stats(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES) -> DataFrame:
    """Per series: last non-null value (of equal times the largest), extremes and the extent of the time axis."""
    known = F.when(F.col(value).isNotNull(), F.struct("ts", value))
    return df.groupBy(*keys).agg(
        F.max_by(value, known).alias("last"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def coverage_tuples(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.select("name", F.array_sort(F.map_keys(labels)).alias("label_keys"), "kind", "unit").distinct()


def coverage_gate(golden: DataFrame, live: DataFrame, strict: bool = False) -> DataFrame:
    """Golden tuples that are no longer live; must be empty."""
    shared = [c for c in golden.columns if c in live.columns]
    missing = golden.select(*shared).distinct().join(live.select(*shared), shared, "left_anti")
    if strict:
        lost = F.raise_error(F.concat(F.lit("coverage lost: "), F.to_json(F.struct(*shared))))
        return missing.where(lost.isNotNull())
    return missing


def latest_snapshot(df: DataFrame, at, keys: Sequence[str] = SERIES, value: str = "raw") -> DataFrame:
    """Newest raw value per series at an instant; of equal times the largest."""
    at = F.lit(at).cast("timestamp")
    return (df.where(F.col("ts") <= at).groupBy(*keys)
            .agg(F.max_by(value, F.struct("ts", value)).alias(value), F.max("ts").alias("last_update"))
            .withColumn("captured", at))


def connection_ports(df: DataFrame, floor: int = 32768) -> DataFrame:
    """Connections with a service port; sockets without an inode are skipped."""
    return (df.where(F.col("inode") != 0).withColumn("port", service_port("sport", "dport", floor))
            .where(F.col("port").isNotNull()))


def port_retransmits(df: DataFrame, floor: int = 32768, chunk=10_000, by: Sequence[str] = ()) -> DataFrame:
    """Running retransmit total per service port, from each connection's increases.

    A port appears once it has retransmitted, and from then on at every tick of ``df`` (within
    ``by``), whether a connection of it is seen or not: at most ports x ticks rows.
    """
    by = list(by)
    scope, port = [*by, "__scope"], [*by, "port"]
    # Ticks are numbered within their scope, so that gaps are sequences of numbers.
    ticks = running_total(df.select(*by, F.col("tick").cast("bigint").alias("tick")).distinct().withColumns({"__scope": F.lit(0), "__one": F.lit(1).cast("bigint")}),
                          scope, ["tick"], "__one", "__no", chunk).select(*by, "tick", "__no")
    deltas = entity_delta(connection_ports(df, floor), [*by, "inode"], "tick", "total_retrans", "port", chunk)
    rises = deltas.groupBy(*port, "tick").agg(F.sum("delta").alias("delta")).where(F.col("delta") > 0)
    totals = running_total(rises, port, ["tick"], "delta", "total", chunk).join(ticks, [*by, "tick"])
    # A total holds until the next rise of its port, the last one until the last tick of its scope.
    ends = ticks.groupBy(*by).agg(F.max("__no").alias("__end"))
    ended = totals.join(ends, by) if by else totals.withColumn("__end", ends.scalar())
    held = with_previous(ended, port, ["tick"], {"__next": "__no"}, chunk, ahead=True)
    upto = F.coalesce(F.col("__next") - 1, F.col("__end"))
    dense = held.select(*port, "total", F.explode(F.sequence("__no", upto)).alias("__no"))
    return dense.join(ticks, [*by, "__no"]).select(*port, "tick", "total")


def port_rtt(df: DataFrame, floor: int = 32768) -> DataFrame:
    """Round-trip readings per service port; zero means none was measured."""
    return connection_ports(df, floor).where(F.col("rtt_us") > 0).select("port", "tick", "rtt_us")


def time_bucket_max(df: DataFrame, width="10 seconds", column: str = "p99", by: Sequence[str] = ("name",)) -> DataFrame:
    us, w = F.unix_micros("ts"), micros(width)
    start = F.timestamp_micros(us - F.pmod(us, F.lit(w)))
    return df.groupBy(*by, start.alias("bucket")).agg(F.max(column).alias(f"max_{column}"))


def peak_by_label(df: DataFrame, label: str = "queue", column: str = "p99", tags: str = "tags") -> DataFrame:
    return (df.groupBy(tag(label, tags).alias(label)).agg(F.max(column).alias("peak"))
            .orderBy(F.desc("peak"), label))


def sum_of_rates_by_label(df: DataFrame, label: str, range="5m", at=None, every=None, labels: str = "labels",
                          keys: Sequence[str] = SERIES, value: str = "raw", tie: Sequence[str] | None = None) -> DataFrame:
    """Sum of instant rates over all series sharing a label value; equal times are ordered by ``tie``, or the value."""
    tie = [value] if tie is None else list(tie)
    rates = irate(df, range, at, every, [*keys, label], value, tie) if label in df.columns else irate(
        df.withColumn(label, tag(label, labels)), range, at, every, [*keys, label], value, tie)
    return rates.groupBy("at", label).agg(F.sum("rate").alias("rate"))


def first_n_series(df: DataFrame, n: int = 8) -> DataFrame:
    """The series initially shown per metric: of its first shape, the first ``n`` to appear."""
    series = df.groupBy(*SERIES, "kind", "unit").agg(F.min("ts").alias("first_ts"))
    shape = (series.groupBy("name").agg(F.min_by(F.struct("kind", "unit"), F.struct("first_ts", "labels_key")).alias("s"))
             .select("name", "s.*"))
    order = Window.partitionBy("name").orderBy("first_ts", "labels_key")
    return (series.join(shape, ["name", "kind", "unit"])
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= n))


def distinct_names(df: DataFrame, substring: str = "") -> DataFrame:
    return name_filter(df, icontains=substring).select("name").distinct().orderBy("name")


def register_views(spark, **frames: DataFrame) -> None:
    """Make the telemetry tables available to ``spark.sql``."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


