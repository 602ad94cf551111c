"""Telemetry-shaped views of the driver tables, in Spark and in SQL.

Each adapter reads its whole table. The SQL twin is a list of CTEs, to be put
after ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetpulse.functions.h2 import h2_bound
from fleetpulse.functions.percentiles import percentile_columns
from fleetpulse.functions.text import encode_labels
from fleetpulse.operators.chunks import running_total
from fleetpulse.operators.histograms import bucket_array

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


# --- SQL fragments -----------------------------------------------------------------

def bound_sql(v: str, g: int = 7) -> str:
    s = f"(length(bin({v})) - {1 + g})"
    return f"(CASE WHEN {v} < {2 ** (g + 1)} THEN {v} ELSE ((({v} >> {s}) + 1) << {s}) - 1 END)"


def rank_sql(p: float, cum: str = "cum", n: str = "n", bound: str = "bound") -> str:
    return f"CAST(min(CASE WHEN {cum} >= greatest(1, ceil({p}::DOUBLE / 100 * {n})) THEN {bound} END) AS BIGINT)"


def percentiles_sql() -> str:
    return ", ".join(f"{rank_sql(p)} AS {name}" for p, name in (
        (50, "p50"), (90, "p90"), (99, "p99"), (99.9, "p999")))


def round_sql(x: str, digits: int) -> str:
    """Half away from zero on the decimal digits, as Spark rounds."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def labels_sql(*pairs: tuple[str, str]) -> str:
    """JSON of labels given in key order."""
    body = " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in pairs)
    return "'{' || " + body + " || '}'"


# --- raw tables --------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    # The column is TIMESTAMP_NTZ; the session runs in UTC.
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def cents(c="value"):
    return F.round(F.col(c) * 100).cast("bigint")


CENTS = "CAST(round(value * 100) AS BIGINT)"


# --- observations ------------------------------------------------------------------

def obs_gauge(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.create_map(F.lit("event_type"), F.col("event_type"))
    return events(spark, sf).select(
        "ts", F.lit("event/value").alias("name"), labels.alias("labels"), encode_labels(labels).alias("labels_key"),
        F.lit("gauge").alias("kind"), F.lit("count").alias("unit"), cents().alias("raw"), "event_id", "user_id", "event_type")


OBS_GAUGE = f"""obs AS (SELECT epoch_us(ts) AS us, 'event/value' AS name, {labels_sql(('event_type', 'event_type'))} AS labels_key,
    'gauge' AS kind, 'count' AS unit, {CENTS} AS raw, event_id, user_id, event_type FROM events)"""


def obs_counter(spark: SparkSession, sf: str, daily_reset: bool = True) -> DataFrame:
    """Running total per event type; it starts over each day, which makes resets."""
    rows = obs_gauge(spark, sf).withColumn("__day", F.to_date("ts"))
    keys = ["name", "labels_key", "__day"] if daily_reset else ["name", "labels_key"]
    return (running_total(rows.withColumn("kind", F.lit("counter")), keys, ["ts", "event_id"], "raw", "total", "1 day")
            .withColumn("raw", F.col("total")).drop("total", "__day"))


def obs_counter_sql(daily_reset: bool = True) -> str:
    day = f", us // {DAY_US}" if daily_reset else ""
    return OBS_GAUGE + f""", counters AS (SELECT us, name, labels_key, event_id, user_id, event_type,
    CAST(sum(raw) OVER (PARTITION BY labels_key{day} ORDER BY us, event_id) AS BIGINT) AS raw FROM obs)"""


# --- roll-up samples ---------------------------------------------------------------

METRIC_OF_EVENT = {
    "view": "network_receive_bytes",
    "click": "network_transmit_bytes",
    "purchase": "nic_queue_rx_bytes",
    "signup": "tcp_rtt_us",
    "error": "tcp_retrans_segs",
}
SAMPLE_US = 6 * HOUR_US


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot rows (ts, name, labels, kind, unit, raw, buckets) every six hours."""
    ev = events(spark, sf)
    us = F.unix_micros("ts")
    metric = F.element_at(F.create_map(*[F.lit(x) for kv in METRIC_OF_EVENT.items() for x in kv]), F.col("event_type"))
    keys = ["us", "name", "iface", "queue"]
    counts = (ev.select((us - F.pmod(us, F.lit(SAMPLE_US))).alias("us"), metric.alias("name"),
                        (F.col("user_id") % 4).alias("iface"), (F.col("user_id") % 16).alias("queue"),
                        h2_bound(cents() * 100_000).alias("bound"))
              .groupBy(*keys, "bound").agg(F.count(F.lit(1)).alias("count")))
    labels = F.create_map(F.lit("iface"), F.concat(F.lit("eth"), F.col("iface").cast("string")),
                          F.lit("queue"), F.col("queue").cast("string"))
    return bucket_array(counts, keys).select(
        F.timestamp_micros("us").alias("ts"), "name", labels.alias("labels"),
        F.when(F.col("name") == "tcp_rtt_us", "distribution").when(F.col("name") == "tcp_retrans_segs", "gauge")
        .otherwise("counter").alias("kind"),
        F.lit("bytes").alias("unit"),
        F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + b["count"]).alias("raw"), "buckets")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up table, with percentiles from the row form of the bucket algebra."""
    ev = events(spark, sf)
    us = F.unix_micros("ts")
    metric = F.element_at(F.create_map(*[F.lit(x) for kv in METRIC_OF_EVENT.items() for x in kv]), F.col("event_type"))
    keys = ["us", "name", "iface", "queue"]
    counts = (ev.select((us - F.pmod(us, F.lit(SAMPLE_US))).alias("us"), metric.alias("name"),
                        (F.col("user_id") % 4).alias("iface"), (F.col("user_id") % 16).alias("queue"),
                        h2_bound(cents() * 100_000).alias("bound"))
              .groupBy(*keys, "bound").agg(F.count(F.lit(1)).alias("count")))
    tags = F.create_map(F.lit("iface"), F.concat(F.lit("eth"), F.col("iface").cast("string")),
                        F.lit("queue"), F.col("queue").cast("string"))
    return percentile_columns(counts, keys, total="raw").select(
        F.timestamp_micros("us").alias("ts"), "name", tags.alias("tags"), "raw", "p50", "p90", "p99", "p999")


_METRIC_SQL = "CASE event_type " + " ".join(
    f"WHEN '{e}' THEN '{m}'" for e, m in METRIC_OF_EVENT.items()) + " END"

SAMPLES = f"""ev AS (SELECT epoch_us(ts) - epoch_us(ts) % {SAMPLE_US} AS us, {_METRIC_SQL} AS name,
    user_id % 4 AS iface, user_id % 16 AS queue, {CENTS} * 100000 AS v FROM events),
bk AS (SELECT us, name, iface, queue, {bound_sql('v')} AS bound, count(*) AS c FROM ev GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER (PARTITION BY us, name, iface, queue ORDER BY bound) AS cum,
    sum(c) OVER (PARTITION BY us, name, iface, queue) AS n FROM bk),
samples AS (SELECT us, name, 'eth' || iface AS iface, CAST(queue AS VARCHAR) AS queue, CAST(max(n) AS BIGINT) AS raw,
    {percentiles_sql()} FROM cm GROUP BY us, name, cm.iface, cm.queue)"""


def cpu_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Per-core usage; some rows from a second source, some the all-CPU line."""
    state = F.element_at(F.array(F.lit("softirq"), F.lit("system"), F.lit("user")), (F.col("event_id") % 3 + 1).cast("int"))
    cpu = F.when(F.col("user_id") % 9 == 0, F.lit("cpu")).otherwise(
        F.concat(F.lit("cpu"), (F.col("user_id") % 8).cast("string")))
    tags = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("cpu"), cpu, F.lit("source"), F.lit("ebpf"))).otherwise(
        F.create_map(F.lit("cpu"), cpu))
    return events(spark, sf).select("ts", F.concat(F.lit("cpu_usage_"), state).alias("name"), tags.alias("tags"),
                                    cents().alias("p50"), (cents() * 2).alias("p99"))


CPU_SAMPLES = f"""cpus AS (SELECT epoch_us(ts) AS us,
    'cpu_usage_' || CASE event_id % 3 WHEN 0 THEN 'softirq' WHEN 1 THEN 'system' ELSE 'user' END AS name,
    CASE WHEN user_id % 9 = 0 THEN 'cpu' ELSE 'cpu' || (user_id % 8) END AS cpu,
    CASE WHEN event_id % 5 = 0 THEN 'ebpf' END AS source, {CENTS} AS p50, {CENTS} * 2 AS p99 FROM events)"""


# --- queues, configuration, context, pairs -----------------------------------------

def queue_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative quantity per (return flag, supplier) and month."""
    li = table(spark, sf, "lineitem")
    tick = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    monthly = (li.groupBy(F.col("l_returnflag").alias("iface"), F.col("l_suppkey").alias("queue"), tick.alias("tick"))
               .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    return running_total(monthly, ["iface", "queue"], ["tick"], "qty", "value", 24).drop("qty")


QUEUE_OBS = """monthly AS (SELECT l_returnflag AS iface, l_suppkey AS queue,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS tick, sum(CAST(l_quantity AS BIGINT)) AS qty
    FROM lineitem GROUP BY ALL),
queues AS (SELECT iface, queue, tick, CAST(sum(qty) OVER (PARTITION BY iface, queue ORDER BY tick) AS BIGINT) AS value FROM monthly)"""

CONFIG_KEY = {
    "1-URGENT": "sysctl.tcp_rmem_max",
    "2-HIGH": "ring.eth0.rx",
    "3-MEDIUM": "mtu.eth0",
    "4-NOT SPECIFIED": "rps.eth1.rx-0",
    "5-LOW": "sysctl.conf.eth0.rp_filter",
}
WEEK_US = 7 * DAY_US


def config_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly snapshots of 20 hosts; the value is the status of the week's latest order."""
    o = table(spark, sf, "orders")
    key = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIG_KEY.items() for x in kv]), F.col("o_orderpriority"))
    week = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(WEEK_US)).cast("bigint")
    return (o.groupBy((F.col("o_custkey") % 20).cast("string").alias("hostname"), week.alias("snapshot"), key.alias("key"))
            .agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("value"),
                 F.max_by(F.col("o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("price")))


_KEY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in CONFIG_KEY.items()) + " END"
CONFIG_OBS = f"""conf AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS hostname, epoch_us(o_orderdate) // {WEEK_US} AS snapshot,
    {_KEY_SQL} AS key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value,
    arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY ALL)"""
DIFF = """, snaps AS (SELECT hostname, snapshot, lag(snapshot) OVER (PARTITION BY hostname ORDER BY snapshot) AS before
    FROM (SELECT DISTINCT hostname, snapshot FROM conf)),
diff AS (SELECT n.hostname, n.snapshot, n.key, o.value AS old_value, n.value AS new_value
    FROM conf n JOIN snaps s ON n.hostname = s.hostname AND n.snapshot = s.snapshot
    JOIN conf o ON o.hostname = n.hostname AND o.key = n.key AND o.snapshot = s.before WHERE o.value <> n.value)"""

SCOPE_OF_EVENT = {"signup": "sysctl", "purchase": "iface", "view": "ethtool_any", "click": "link", "error": "steering"}
FIRST_WEEK, WEEKS = 1304, 344


def change_events(spark: SparkSession, sf: str) -> DataFrame:
    """Attribution events, spread over the weeks of the configuration snapshots."""
    scope = F.element_at(F.create_map(*[F.lit(x) for kv in SCOPE_OF_EVENT.items() for x in kv]), F.col("event_type"))
    leaf = F.element_at(F.array(F.lit("tcp_rmem"), F.lit("rp_filter"), F.lit("rmem_max")), (F.col("user_id") % 3 + 1).cast("int"))
    arg = F.when(F.col("event_type") == "signup", leaf).when(
        F.col("event_type") == "purchase", F.concat(F.lit("eth"), (F.col("user_id") % 2).cast("string")))
    return events(spark, sf).select(
        (F.col("event_id") % WEEKS + FIRST_WEEK).alias("window_id"), F.col("event_id").alias("seq"),
        F.col("user_id").alias("pid"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("comm"),
        scope.alias("scope"), arg.alias("arg"))


CHANGE_EVENTS = f"""attr AS (SELECT event_id % {WEEKS} + {FIRST_WEEK} AS window_id, event_id AS seq, user_id AS pid,
    'u' || (user_id % 7) AS comm, CASE event_type """ + " ".join(
    f"WHEN '{e}' THEN '{s}'" for e, s in SCOPE_OF_EVENT.items()) + """ END AS scope,
    CASE event_type WHEN 'signup' THEN CASE user_id % 3 WHEN 0 THEN 'tcp_rmem' WHEN 1 THEN 'rp_filter' ELSE 'rmem_max' END
        WHEN 'purchase' THEN 'eth' || (user_id % 2) END AS arg FROM events)"""


def context_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Driver and MTU per nation's interface, a new version per supplier."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    # nation and region are fixed-size dimensions; AQE broadcasts what it measures as small.
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    valid = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("s_suppkey") * F.lit(HOUR_US) * 7 % F.lit(30 * DAY_US)
                               + F.col("s_suppkey"))
    return j.select(F.concat(F.lit("if"), (F.col("n_nationkey") % 10).cast("string")).alias("iface"), valid.alias("ts"),
                    F.col("r_name").alias("driver"), (F.lit(1500) + F.col("s_suppkey") % 3 * 3750).alias("mtu"))


CONTEXT_DIM = f"""ctx AS (SELECT 'if' || (n_nationkey % 10) AS iface,
    1704067200000000 + s_suppkey * {HOUR_US} * 7 % {30 * DAY_US} + s_suppkey AS us,
    r_name AS driver, CAST(1500 + s_suppkey % 3 * 3750 AS VARCHAR) AS mtu
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ACTION_OF_EVENT = {"view": "start", "purchase": "end", "error": "destroy", "click": "other", "signup": "other"}


def pair_events(spark: SparkSession, sf: str) -> DataFrame:
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_OF_EVENT.items() for x in kv]), F.col("event_type"))
    return events(spark, sf).withColumn("action", action)


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """Connection statistics per four-hour tick; one row per (tick, inode)."""
    ev = events(spark, sf)
    tick = F.floor(F.unix_micros("ts") / F.lit(4 * HOUR_US)).cast("bigint")
    return (ev.groupBy(tick.alias("tick"), (F.col("user_id") % 12).alias("inode"))
            .agg(F.sum(cents()).alias("v"), F.max("event_id").alias("last"))
            .select("tick", "inode", (F.col("inode") % 3 * 20000 + 80).cast("int").alias("sport"),
                    (F.col("last") % 2 * 40000 + 443).cast("int").alias("dport"),
                    (F.col("v") % 500).alias("rtt_us"), (F.col("v") % 1000).alias("total_retrans")))


CONNECTIONS = f"""conns AS (SELECT tick, inode, inode % 3 * 20000 + 80 AS sport, last % 2 * 40000 + 443 AS dport,
    CAST(v % 500 AS BIGINT) AS rtt_us, CAST(v % 1000 AS BIGINT) AS total_retrans FROM (
    SELECT epoch_us(ts) // {4 * HOUR_US} AS tick, user_id % 12 AS inode, sum({CENTS}) AS v, max(event_id) AS last
    FROM events GROUP BY ALL))"""
PORT_SQL = """CASE WHEN sport < 32768 AND dport < 32768 THEN least(sport, dport) WHEN sport < 32768 THEN sport
    WHEN dport < 32768 THEN dport END"""
