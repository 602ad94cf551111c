"""Table schemas. Every reader states its schema; nothing is inferred."""

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

U64 = T.DecimalType(20, 0)
U64_MAX = 2**64 - 1


def u64(value: int) -> Column:
    """An unsigned 64-bit literal."""
    return F.lit(Decimal(value)).cast(U64)


KINDS = ("counter", "gauge", "distribution")
UNITS = ("bytes", "count", "seconds", "percent", "none")
ROLLUP_PERCENTILES = (50.0, 90.0, 99.0, 99.9)
ROLLUP_COLUMNS = ("p50", "p90", "p99", "p999")

# The columns that identify a series, and the map kept beside them.
SERIES = ("name", "labels_key")

LABELS = T.MapType(T.StringType(), T.StringType())


def bucket_array_type(number=T.LongType()):
    return T.ArrayType(T.StructType([
        T.StructField("bound", number),
        T.StructField("count", number),
    ]))


RECORDING = T.StructType([
    T.StructField("ts_unix_ms", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("labels_json", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("raw", U64),
    T.StructField("buckets_json", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("name", T.StringType()),
    T.StructField("tags", LABELS),
    T.StructField("raw", U64),
    T.StructField("p50", T.LongType()),
    T.StructField("p90", T.LongType()),
    T.StructField("p99", T.LongType()),
    T.StructField("p999", T.LongType()),
])

CONFIG_VALUES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

CONFIG_CHANGES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("note", T.StringType()),
])

CONFIG_SNAPSHOTS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("snapshot", T.StringType()),
])

_QUEUE_VALUE = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("value", T.StringType()),
]))

_INTERFACE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("driver", "driver_version", "fw_version", "bus_info")]
    + [T.StructField(n, T.LongType()) for n in (
        "mtu", "ring_rx_max", "ring_rx", "ring_tx_max", "ring_tx", "rx_queues", "tx_queues",
        "combined_queues", "msix_vectors", "rss_table_size", "coalesce_rx_usecs",
        "coalesce_tx_usecs", "rp_filter")]
    + [T.StructField("steering", T.StructType([
        T.StructField(n, _QUEUE_VALUE) for n in ("rps", "xps", "irq_affinity")]))]
)

CONFIG_STATE = T.StructType([
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("kernel", T.StringType()),
    T.StructField("sysctl", T.StructType(
        [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("tcp_rmem", "tcp_wmem")]
        + [T.StructField(n, T.LongType()) for n in ("rmem_max", "wmem_max", "rmem_default", "wmem_default")]
        + [T.StructField(n, T.IntegerType()) for n in (
            "netdev_max_backlog", "somaxconn", "tcp_max_syn_backlog", "tcp_fastopen",
            "tcp_slow_start_after_idle")]
        + [T.StructField("tcp_congestion_control", T.StringType())])),
    T.StructField("interfaces", T.MapType(T.StringType(), _INTERFACE)),
])

ATTRIBUTION_EVENT = T.StructType([
    T.StructField("window_id", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("pid", T.LongType()),
    T.StructField("comm", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("arg", T.StringType()),
])

CONNECTION_STATS = T.StructType([
    T.StructField("tick", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sport", T.IntegerType()),
    T.StructField("dport", T.IntegerType()),
    T.StructField("inode", T.LongType()),
    T.StructField("rtt_us", T.LongType()),
    T.StructField("total_retrans", T.LongType()),
])

GROUP_READING = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("cpu", T.IntegerType()),
    T.StructField("group", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("counts", T.ArrayType(U64)),
    T.StructField("enabled", T.LongType()),
    T.StructField("running", T.LongType()),
])

DENSE_HISTOGRAM = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("counts", T.ArrayType(T.LongType())),
])

QUEUE_COUNTERS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("iface", T.StringType()),
    T.StructField("stat_name", T.StringType()),
    T.StructField("value", U64),
])

# Text captures: one row per line, with where and when it was taken.
CAPTURE_LINES = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("path", T.StringType()),
    T.StructField("value", T.StringType()),
])
