"""Queries that parse captured text. The lines are derived from the tables, one capture per row or group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetpulse.plans.adapters import CENTS, cents, events
from fleetpulse.plans.registry import plan
from fleetpulse.session import scratch
from fleetpulse.sources import captures as S


def _lines(df: DataFrame, *values, path="capture") -> DataFrame:
    """One line per expression and row of ``df``; the row's id names the host."""
    return df.select(F.col("event_id").cast("string").alias("host"), "ts", F.lit(path).alias("path"),
                     F.explode(F.array(*values)).alias("value"))


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@plan("ingest_exposition_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, name, label_keys, event, path, CAST(v AS DOUBLE) AS value, sample_ms FROM (
SELECT event_id, 'm_' || event_type AS name, 'event,path' AS label_keys, event_type AS event, 'a,' || user_id || '"}}' AS path, {CENTS} AS v, epoch_us(ts) // 1000 AS sample_ms FROM events
UNION ALL SELECT event_id, 'some_value', '', NULL, NULL, user_id, NULL FROM events)""")
def ingest_exposition_text(spark, sf):
    ev = events(spark, sf)
    sample = F.concat(F.lit("m_"), "event_type", F.lit('_rate{path="a,'), _s("user_id"), F.lit('\\"}",event="'), "event_type",
                      F.lit('",percentile="99"} '), _s(cents()), F.lit(" "), _s(F.unix_millis("ts")))
    lines = _lines(ev, F.lit("# TYPE m gauge"), F.lit("  "), sample, F.concat(F.lit("some_value_value{} "), _s("user_id")))
    out = S.ingest_exposition_text(lines)
    return out.select("host", "name", F.array_join("label_keys", ",").alias("label_keys"), F.try_element_at("labels", F.lit("event")).alias("event"),
                      F.try_element_at("labels", F.lit("path")).alias("path"), "value", "sample_ms")


@plan("ingest_kv_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, 'memory/memfree' AS name, {CENTS} * 1024 AS raw FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 'memory/hugepages_total', user_id FROM events""")
def ingest_kv_text(spark, sf):
    lines = _lines(events(spark, sf), F.concat(F.lit("MemFree:     "), _s(cents()), F.lit(" kB")), F.concat(F.lit("HugePages_Total:    "), _s("user_id")),
                   F.concat(F.lit("VmallocTotal:   "), _s("user_id"), F.lit(" kB")), F.lit("Broken: x"))
    return S.ingest_kv_text(lines).select("host", "name", F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_pair_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, 'Ip6' AS proto, 'Ip6InReceives' AS field, {CENTS} AS value FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 'Icmp6', 'Icmp6InPktTooBigs', user_id FROM events""")
def ingest_pair_text(spark, sf):
    lines = _lines(events(spark, sf), F.concat(F.lit("Ip6InReceives                   \t"), _s(cents())),
                   F.concat(F.lit("Icmp6InPktTooBigs \t"), _s("user_id")), F.lit("Ip6Broken -1"))
    return S.ingest_pair_text(lines).select("host", "proto", "field", F.col("value").cast("bigint").alias("value"))


@plan("ingest_header_pair_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, 'Tcp' AS proto, 'ActiveOpens' AS field, {CENTS} AS value FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 'Tcp', 'InSegs', user_id FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), 'Udp', 'NoPorts', event_id FROM events""")
def ingest_header_pair_text(spark, sf):
    lines = _lines(events(spark, sf), F.lit("Tcp: MaxConn ActiveOpens InSegs"), F.concat(F.lit("Tcp: -1 "), _s(cents()), F.lit(" "), _s("user_id")),
                   F.lit("Udp: NoPorts"), F.concat(F.lit("Udp: "), _s("event_id")))
    return S.ingest_header_pair_text(lines).select("host", "proto", "field", F.col("value").cast("bigint").alias("value"))


@plan("ingest_cpu_text", """SELECT CAST(event_id AS VARCHAR) AS host, 'cpu/usage/' || state AS name, 'cpu' || (user_id % 8) AS cpu, CASE i WHEN 7 THEN 0 ELSE user_id * (i + 1) END AS raw
FROM events, (VALUES (0, 'user'), (1, 'nice'), (2, 'system'), (3, 'idle'), (4, 'iowait'), (5, 'irq'), (6, 'softirq'), (7, 'steal')) AS s(i, state)""")
def ingest_cpu_text(spark, sf):
    fields = F.concat_ws(" ", F.concat(F.lit("cpu"), _s(F.col("user_id") % 8)), *[_s(F.col("user_id") * (i + 1)) for i in range(7)])
    lines = _lines(events(spark, sf), fields, F.lit("cpu1 1 2 3"), F.lit("intr 12345"))
    return S.ingest_entity_table_text(lines, "cpu").select("host", "name", F.col("labels")["cpu"].alias("cpu"), F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_interface_text", """SELECT CAST(event_id AS VARCHAR) AS host, 'network/' || field AS name, 'eth' || (user_id % 4) AS iface, user_id * (i + 1) AS raw
FROM events, (VALUES (0, 'receive/bytes'), (2, 'receive/errors'), (3, 'receive/dropped'), (8, 'transmit/bytes'), (10, 'transmit/errors'), (11, 'transmit/dropped')) AS s(i, field)""")
def ingest_interface_text(spark, sf):
    row = F.concat(F.lit("  eth"), _s(F.col("user_id") % 4), F.lit(": "), F.concat_ws("   ", *[_s(F.col("user_id") * (i + 1)) for i in range(16)]))
    lines = _lines(events(spark, sf), F.lit("Inter-|   Receive   |  Transmit"), F.lit(" face |bytes: packets"), row, F.lit("lo: 1 2 3"))
    return S.ingest_entity_table_text(lines, "interface").select("host", "name", F.col("labels")["iface"].alias("iface"), F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_disk_text", """SELECT CAST(event_id AS VARCHAR) AS host, 'disk/' || field AS name, 'sd' || (user_id % 4) AS device, user_id * (i + 1) * 512 AS raw
FROM events, (VALUES (2, 'read/bytes'), (6, 'write/bytes')) AS s(i, field)""")
def ingest_disk_text(spark, sf):
    row = F.concat(F.lit("   8       0 sd"), _s(F.col("user_id") % 4), F.lit(" "), F.concat_ws(" ", *[_s(F.col("user_id") * (i + 1)) for i in range(11)]))
    lines = _lines(events(spark, sf), row, F.lit("8 0 short 1 2"))
    return S.ingest_entity_table_text(lines, "disk").select("host", "name", F.col("labels")["device"].alias("device"), F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_load_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, 'cpu/load/' || n AS name, {CENTS} * m AS raw FROM events, (VALUES ('load1', 1), ('load5', 2), ('load15', 3)) AS s(n, m)""")
def ingest_load_text(spark, sf):
    def hundredths(m):
        return F.format_string("%d.%02d", F.floor(cents() * m / 100), cents() * m % 100)

    lines = _lines(events(spark, sf), F.concat_ws(" ", hundredths(1), hundredths(2), hundredths(3), F.lit("2/312"), F.lit("98765")), F.lit("x y z"))
    return S.ingest_pressure_load_text(lines, "load").select("host", "name", F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_pressure_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, 'psi/memory/' || n AS name, {CENTS} % m AS raw FROM events,
(VALUES ('some_avg10', 10000), ('some_avg60', 1000), ('some_avg300', 100), ('full_avg10', 5000), ('full_avg60', 500), ('full_avg300', 50)) AS s(n, m)""")
def ingest_pressure_text(spark, sf):
    def hundredths(m):
        return F.format_string("%d.%02d", F.floor(cents() % m / 100), cents() % m % 100)

    def line(kind, a, b, c):
        return F.concat(F.lit(f"{kind} avg10="), hundredths(a), F.lit(" avg60="), hundredths(b), F.lit(" avg300="), hundredths(c), F.lit(" total=123456"))

    lines = _lines(events(spark, sf), line("some", 10000, 1000, 100), line("full", 5000, 500, 50), path="proc_pressure_memory")
    return S.ingest_pressure_load_text(lines, "pressure").select("host", "name", F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_socket_text", """SELECT CAST(event_id AS VARCHAR) AS host, 'net/sockets/' || n AS name, CASE n WHEN 'tcp_inuse' THEN user_id WHEN 'tcp_tw' THEN event_id WHEN 'tcp_orphan' THEN 0 ELSE user_id + 1 END AS raw
FROM events, (VALUES ('tcp_inuse'), ('tcp_tw'), ('tcp_orphan'), ('udp_inuse')) AS s(n)""")
def ingest_socket_text(spark, sf):
    lines = _lines(events(spark, sf), F.lit("sockets: used 248"), F.concat(F.lit("TCP: inuse "), _s("user_id"), F.lit(" tw "), _s("event_id"), F.lit(" alloc 14 mem 2")),
                   F.concat(F.lit("UDP: inuse "), _s(F.col("user_id") + 1), F.lit(" mem 0")), F.lit("UDPLITE: inuse 9"))
    return S.ingest_pressure_load_text(lines, "socket").select("host", "name", F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_matrix_text", f"""SELECT CAST(event_id AS VARCHAR) AS host, 'softirq/' || n AS name, CASE n WHEN 'net_rx' THEN {CENTS} * 3 ELSE user_id * 2 + 1 END AS raw FROM events, (VALUES ('net_rx'), ('timer')) AS s(n)""")
def ingest_matrix_text(spark, sf):
    lines = _lines(events(spark, sf), F.lit("                    CPU0       CPU1"), F.concat(F.lit("      NET_RX:    "), _s(cents()), F.lit("   "), _s(cents() * 2)),
                   F.concat(F.lit("       TIMER: "), _s("user_id"), F.lit(" "), _s(F.col("user_id") + 1)))
    return S.ingest_matrix_text(lines).select("host", "name", F.col("raw").cast("bigint").alias("raw"))


@plan("ingest_captured_files", f"""WITH e AS (SELECT 'h' || (user_id % 5) AS host, epoch_us(ts) // 1000 // 86400000 * 86400000 AS ts_ms, event_id, user_id, {CENTS} AS c FROM events)
SELECT host, ts_ms, 'memory/slot' || event_id AS name, c * 1024 AS raw FROM e
UNION ALL SELECT host, ts_ms, 'Ip6Seen' || event_id, user_id FROM e""")
def ingest_captured_files(spark, sf):
    """Captures as files, a folder per kind, host and day: host and time come from the path."""
    path = scratch(spark, "captures")
    day = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(86_400_000))
    lines = events(spark, sf).select(F.concat(F.lit("h"), _s(F.col("user_id") % 5)).alias("host"), day.alias("ms"), F.explode(F.array(
        F.struct(F.lit("meminfo").alias("kind"), F.concat(F.lit("Slot"), _s("event_id"), F.lit(":   "), _s(cents()), F.lit(" kB")).alias("value")),
        F.struct(F.lit("snmp6").alias("kind"), F.concat(F.lit("Ip6Seen"), _s("event_id"), F.lit("   \t"), _s("user_id")).alias("value")))).alias("line"))
    (lines.select("host", "ms", "line.*").repartition("kind", "host", "ms")
     .write.partitionBy("kind", "host", "ms").text(path))
    pattern = r"host=([^/]+)/ms=(\d+)/[^/]*$"
    memory = S.ingest_kv_text(S.read_captures(spark, f"{path}/kind=meminfo", pattern))
    pairs = S.ingest_pair_text(S.read_captures(spark, f"{path}/kind=snmp6", pattern))
    at = F.unix_millis("ts").alias("ts_ms")
    return memory.select("host", at, "name", F.col("raw").cast("bigint").alias("raw")).unionByName(
        pairs.select("host", at, F.col("field").alias("name"), F.col("value").cast("bigint").alias("raw")))
