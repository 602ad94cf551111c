"""Queries for configuration changes, attribution and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import config as C, joins as J
from fleetpulse.plans.adapters import (
    CENTS, CHANGE_EVENTS, CONFIG_OBS, CONTEXT_DIM, DAY_US, DIFF, HOUR_US, OBS_GAUGE, WEEK_US, cents, change_events, config_obs,
    context_dim, events, obs_gauge, round_sql, table)
from fleetpulse.plans.registry import plan

# The SQL states each rule as a condition on a (change, event) pair.
_RULE = """CASE
    WHEN starts_with(d.key, 'sysctl.') THEN CASE WHEN a.scope = 'sysctl' AND a.arg <> '' AND (starts_with(substr(d.key, 8), a.arg)
        OR ends_with(substr(d.key, 8), '.' || a.arg)) THEN 1 END
    WHEN regexp_matches(d.key, '^(rps|xps|irq)[.]') THEN CASE WHEN a.scope = 'steering' THEN 1 END
    WHEN a.scope = 'iface' AND a.arg = split_part(d.key, '.', 2) THEN 1
    WHEN a.scope = 'ethtool_any' AND regexp_matches(d.key, '^(ring|channels|coalesce|rss|msix)[.]') THEN 2
    WHEN a.scope = 'link' AND starts_with(d.key, 'mtu.') THEN 3 END"""
_ATTRIBUTED = f"""hits AS (SELECT d.*, a.pid, a.comm, row_number() OVER (PARTITION BY d.hostname, d.snapshot, d.key ORDER BY {_RULE}, a.seq) AS rn
    FROM diff d JOIN attr a ON a.window_id = d.snapshot WHERE {_RULE} IS NOT NULL),
named AS (SELECT d.hostname, d.snapshot, d.key, d.old_value, d.new_value, coalesce(h.pid, 0) AS pid, coalesce(h.comm, 'unknown') AS comm
    FROM diff d LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h USING (hostname, snapshot, key))"""


def _changes(spark, sf):
    return C.config_diff(config_obs(spark, sf).drop("price"), chunk=26)


@plan("attribute_changes", f"WITH {CONFIG_OBS}{DIFF}, {CHANGE_EVENTS}, {_ATTRIBUTED} SELECT * FROM named")
def attribute_changes(spark, sf):
    return J.attribute_changes(_changes(spark, sf).withColumn("window_id", F.col("snapshot")), change_events(spark, sf)).drop("window_id")


@plan("change_timeline", f"""WITH {CONFIG_OBS}{DIFF}, {CHANGE_EVENTS}, {_ATTRIBUTED}
SELECT hostname, snapshot, key, pid, key || ': ' || old_value || ' → ' || new_value || '  (pid=' || pid || ', comm=' || comm || ')' AS note FROM named""")
def change_timeline(spark, sf):
    snaps = config_obs(spark, sf).drop("price").withColumn("window_id", F.col("snapshot"))
    return C.change_timeline(snaps, change_events(spark, sf), chunk=26).select("hostname", "snapshot", "key", "pid", "note")


@plan("change_notes", f"""WITH {CONFIG_OBS}{DIFF}, n AS (SELECT hostname, snapshot, key, CAST(ascii(old_value) * 123457 AS VARCHAR) AS o, CAST(ascii(new_value) * 123457 AS VARCHAR) AS n FROM diff)
SELECT hostname, snapshot, key, CASE key
    WHEN 'sysctl.tcp_rmem_max' THEN key || ': ' || o || ' (' || CAST(round(CAST(o AS BIGINT) / 1e6) AS BIGINT) || 'MB) → ' || n || ' (' || CAST(round(CAST(n AS BIGINT) / 1e6) AS BIGINT) || 'MB)'
    WHEN 'ring.eth0.rx' THEN 'ring.rx: ' || o || ' → ' || n || '  (eth0)'
    WHEN 'mtu.eth0' THEN 'MTU: ' || o || ' → ' || n || '  (eth0)'
    ELSE key || ': ' || o || ' → ' || n END AS note FROM n""")
def change_notes(spark, sf):
    def number(c):
        return (F.ascii(c) * 123457).cast("string")

    rows = _changes(spark, sf).withColumns({"old_value": number("old_value"), "new_value": number("new_value"),
                                            "ts": F.timestamp_micros(F.col("snapshot") * WEEK_US)})
    return C.change_rows(rows).select("hostname", F.floor(F.unix_micros("ts") / F.lit(WEEK_US)).alias("snapshot"), "key", "note")


@plan("stamp_changes", f"WITH {CONFIG_OBS}{DIFF} SELECT hostname, snapshot, key, 0 AS pid, 'poll' AS comm FROM diff")
def stamp_changes(spark, sf):
    return J.stamp_changes(_changes(spark, sf), 0, "poll").select("hostname", "snapshot", "key", "pid", "comm")


@plan("config_values", f"""WITH {CONFIG_OBS}, v AS (SELECT hostname, snapshot, key, CASE WHEN value = 'F' THEN 'f000' WHEN value = 'O' THEN '1e5' ELSE CAST(CAST(floor(price) AS BIGINT) AS VARCHAR) END AS value FROM conf)
SELECT hostname, snapshot, key, TRY_CAST(value AS DOUBLE) AS value FROM v WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL""")
def config_values(spark, sf):
    text = F.when(F.col("value") == "F", "f000").when(F.col("value") == "O", "1e5").otherwise(
        F.floor("price").cast("string"))
    return C.config_values(config_obs(spark, sf).withColumn("value", text).drop("price")).select("hostname", "snapshot", "key", "value")


@plan("latest_config_snapshot", """SELECT CAST(o_custkey % 20 AS VARCHAR) AS hostname, epoch_us(o_orderdate) AS us, max(o_orderkey) AS version,
arg_max(o_orderpriority, o_orderkey) AS snapshot FROM orders GROUP BY ALL""")
def latest_config_snapshot(spark, sf):
    rows = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).cast("string").alias("hostname"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("snapshot"))
    return C.latest_config_snapshot(rows, ["hostname", "us"])


def config_states(spark, sf):
    """One nested configuration row per order; two interfaces with steering lists."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")

    def iface(n):
        fields = {f: (k * (i + 1) + n).cast("bigint") for i, f in enumerate((
            "mtu", "ring_rx_max", "ring_rx", "ring_tx_max", "ring_tx", "rx_queues", "tx_queues", "combined_queues", "msix_vectors",
            "rss_table_size", "coalesce_rx_usecs", "coalesce_tx_usecs", "rp_filter"))}
        steering = F.struct(*[F.array(F.struct(F.lit(n).cast("bigint").alias("id"), F.hex(k).alias("value"))).alias(c)
                              for c in ("rps", "xps", "irq_affinity")])
        return F.struct(*[v.alias(f) for f, v in fields.items()], steering.alias("steering"))

    sysctl = F.struct(F.array(F.lit(4096), F.lit(131072), k.cast("int")).alias("tcp_rmem"), F.array(F.lit(4096), F.lit(16384), (k * 2).cast("int")).alias("tcp_wmem"),
                      (k * 3).alias("rmem_max"), (k * 4).alias("wmem_max"), (k * 5).cast("int").alias("netdev_max_backlog"),
                      (k % 2).cast("int").alias("tcp_slow_start_after_idle"), F.lit("cubic").alias("tcp_congestion_control"))
    return o.select(k.alias("timestamp_ms"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("hostname"), sysctl.alias("sysctl"),
                    F.create_map(F.lit("eth0"), iface(0), F.lit("eth1"), iface(1)).alias("interfaces"))


_NUMBERED = {"mtu.{}": 1, "ring.{}.rx_max": 2, "ring.{}.rx": 3, "ring.{}.tx": 5, "channels.{}.rx": 6, "channels.{}.tx": 7, "channels.{}.combined": 8,
             "msix.{}.vectors": 9, "rss.{}.table_size": 10, "coalesce.{}.rx_usecs": 11, "coalesce.{}.tx_usecs": 12, "sysctl.conf.{}.rp_filter": 13}
_FLAT = " UNION ALL ".join(
    [f"SELECT k, hostname, 'sysctl.{n}', CAST({e} AS VARCHAR) FROM o" for n, e in (
        ("tcp_rmem_max", "k"), ("tcp_wmem_max", "k * 2"), ("rmem_max", "k * 3"), ("wmem_max", "k * 4"), ("netdev_max_backlog", "k * 5"),
        ("tcp_slow_start_after_idle", "k % 2"), ("tcp_congestion_control", "'cubic'"))]
    + [f"SELECT k, hostname, '{p.format(f'eth{i}')}', CAST(k * {m} + {i} AS VARCHAR) FROM o" for p, m in _NUMBERED.items() for i in (0, 1)]
    + [f"SELECT k, hostname, '{p.format(f'eth{i}')}{i}', hex(k) FROM o" for p in ("rps.{}.rx-", "xps.{}.tx-", "irq.{}.") for i in (0, 1)])


@plan("flatten_config", f"""WITH o AS (SELECT o_orderkey AS k, 'h' || o_custkey AS hostname FROM orders), f(k, hostname, key, value) AS ({_FLAT})
SELECT k AS ts_ms, hostname, key, value FROM f""")
def flatten_config(spark, sf):
    return C.flatten_config(config_states(spark, sf)).select(F.unix_millis("ts").alias("ts_ms"), "hostname", "key", "value")


_OBS_IF = f"oi AS (SELECT epoch_us(ts) AS us, event_id, 'if' || (user_id % 12) AS iface FROM events)"


@plan("enrich_context", f"""WITH {CONTEXT_DIM}, {_OBS_IF},
r AS (SELECT o.event_id, o.iface, c.driver, c.mtu FROM oi o ASOF LEFT JOIN ctx c ON o.iface = c.iface AND o.us >= c.us)
SELECT event_id, iface, coalesce(driver, '') AS driver, coalesce(mtu, '') AS mtu FROM r""")
def enrich_context(spark, sf):
    obs = events(spark, sf).select("ts", "event_id", F.concat(F.lit("if"), (F.col("user_id") % 12).cast("string")).alias("iface"))
    return J.enrich_context(obs, context_dim(spark, sf), chunk="2 days").select("event_id", "iface", "driver", "mtu")


@plan("annotate", f"""WITH {OBS_GAUGE}, c AS (SELECT s_suppkey AS change, 1704067200000000 + s_suppkey * {5 * HOUR_US} AS at_us FROM supplier)
SELECT change, event_id, us - at_us AS offset_us FROM c JOIN obs ON us BETWEEN at_us - {2 * HOUR_US} AND at_us + {3 * HOUR_US}""")
def annotate(spark, sf):
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("s_suppkey") * (5 * HOUR_US))
    changes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("change"), at.alias("change_ts"))
    out = J.annotate(obs_gauge(spark, sf), changes, "2 hours", "3 hours")
    return out.select("change", "event_id", (F.unix_micros("ts") - F.unix_micros("change_ts")).alias("offset_us"))


_DEVICE = "CASE event_id % 3 WHEN 0 THEN 'nvme' || user_id % 5 || 'n1' WHEN 1 THEN 'nvme' || user_id % 7 || 'c' || user_id % 2 || 'n1' ELSE 'sd' || user_id % 4 END"


@plan("alias_fold", f"""WITH d AS (SELECT {_DEVICE} AS device, {CENTS} AS v FROM events), heads AS (SELECT DISTINCT device FROM d WHERE regexp_matches(device, '^nvme\\d+n\\d+$')),
m AS (SELECT v, device, CASE WHEN regexp_matches(device, '^nvme\\d+c\\d+n\\d+$') THEN regexp_replace(device, 'c\\d+', '') END AS head FROM d)
SELECT CASE WHEN h.device IS NOT NULL THEN m.head ELSE m.device END AS device, CAST(sum(v) AS BIGINT) AS value FROM m LEFT JOIN heads h ON h.device = m.head GROUP BY 1""")
def alias_fold(spark, sf):
    u, n = F.col("user_id"), F.col("event_id") % 3
    device = (F.when(n == 0, F.concat(F.lit("nvme"), (u % 5).cast("string"), F.lit("n1")))
              .when(n == 1, F.concat(F.lit("nvme"), (u % 7).cast("string"), F.lit("c"), (u % 2).cast("string"), F.lit("n1")))
              .otherwise(F.concat(F.lit("sd"), (u % 4).cast("string"))))
    rows = events(spark, sf).select(device.alias("device"), cents().alias("value"))
    heads = rows.where(F.col("device").rlike(r"^nvme\d+n\d+$")).select("device").distinct()
    return J.alias_fold(rows, heads)


@plan("sources_side_by_side", f"""WITH s AS (SELECT 'cpu_' || event_type AS name, epoch_us(ts) - epoch_us(ts) % {DAY_US} AS bucket, event_id % 4 = 0 AS second, user_id % 3 AS cpu, {CENTS} AS v FROM events)
SELECT name, '{{"cpu":"' || cpu || '"}}' AS labels_key, bucket, max(CASE WHEN NOT second THEN v END) AS procfs, max(CASE WHEN second THEN v END) AS ebpf,
{round_sql('max(CASE WHEN second THEN v END) / max(CASE WHEN NOT second THEN v END)', 6)} AS ratio FROM s GROUP BY ALL""")
def sources_side_by_side(spark, sf):
    cpu = (F.col("user_id") % 3).cast("string")
    tags = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("cpu"), cpu, F.lit("source"), F.lit("ebpf"))).otherwise(
        F.create_map(F.lit("cpu"), cpu))
    rows = events(spark, sf).select("ts", F.concat(F.lit("cpu_"), "event_type").alias("name"), tags.alias("tags"), cents().alias("p99"))
    out = J.sources_side_by_side(rows, "1 day")
    return out.select("name", "labels_key", F.unix_micros("bucket").alias("bucket"), "procfs", "ebpf", F.round("ratio", 6).alias("ratio"))
