"""Queries for scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import network as N, text as X
from fleetpulse.operators import filters as FL
from fleetpulse.plans.adapters import CENTS, SAMPLES, cents, events, labels_sql, round_sql, samples, table
from fleetpulse.plans.registry import plan


@plan("sanitize_name", """SELECT raw, replace(raw, '/', '_') AS rollup, replace(replace(raw, '/', '_'), '-', '_') AS exposition,
regexp_replace(raw, '[^A-Za-z0-9_]', '_', 'g') AS driver, count(*) AS n
FROM (SELECT p_brand || '/' || p_name || '-' || p_type AS raw FROM part) GROUP BY ALL""")
def sanitize_name(spark, sf):
    raw = F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), "p_type").alias("raw")
    return (table(spark, sf, "part").select(raw).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
            .select("raw", *[X.sanitize_name("raw", s).alias(s) for s in ("rollup", "exposition", "driver")], "n"))


@plan("series_key", f"""SELECT {labels_sql(('event_type', 'event_type'), ('user', 'user_id'))} AS labels_key, true AS same_key, count(*) AS n
FROM events GROUP BY ALL""")
def series_key(spark, sf):
    a = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    b = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"))
    name = F.lit("event/value")
    rows = events(spark, sf).select(X.encode_labels(b).alias("labels_key"), (X.series_key(name, a) == X.series_key(name, b)).alias("same"))
    return rows.groupBy("labels_key").agg(F.bool_and("same").alias("same_key"), F.count(F.lit(1)).alias("n"))


@plan("labels_codec", r"""SELECT event_id, json_object('event_type', event_type, 'note', note, 'user', CAST(user_id AS VARCHAR)) AS labels_json,
note FROM (SELECT *, event_type || chr(34) || chr(92) || chr(10) || chr(9) || event_id AS note FROM events)""")
def labels_codec(spark, sf):
    note = F.concat("event_type", F.lit('"\\\n\t'), F.col("event_id").cast("string"))
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("note"), note, F.lit("event_type"), F.col("event_type"))
    rows = events(spark, sf).select("event_id", X.encode_labels(labels).alias("labels_json"))
    return rows.withColumn("note", X.decode_labels("labels_json")["note"])


@plan("unit_convert", f"""SELECT event_id, {round_sql('v * 100000 / 1.25e8', 2)} AS gbps, v * 1024 AS kib_bytes, v * 512 AS sector_bytes,
CAST(round(value * 100) AS BIGINT) AS hundredths, v / 1e6 AS mb, v // 1000 AS us FROM (SELECT *, {CENTS} AS v FROM events)""")
def unit_convert(spark, sf):
    v = F.col("v")
    return events(spark, sf).withColumn("v", cents()).select(
        "event_id", N.to_gbps(v * 100_000).alias("gbps"), N.kib_to_bytes(v).alias("kib_bytes"), N.sectors_to_bytes(v).alias("sector_bytes"),
        N.fixed_point("value").alias("hundredths"), N.megabytes(v).alias("mb"), N.ns_to_us(v).alias("us"))


@plan("lookback", f"WITH {SAMPLES} SELECT us, name, iface, queue, p99 FROM samples WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-20')")
def lookback(spark, sf):
    rows = FL.lookback(samples(spark, sf), "2024-01-20 00:00:00", minutes=14_400, until="2024-01-20 00:00:00")
    return rows.select(F.unix_micros("ts").alias("us"), "name", F.col("tags")["iface"].alias("iface"), F.col("tags")["queue"].alias("queue"), "p99")


@plan("label_filter", f"WITH {SAMPLES} SELECT us, name, queue, p50 FROM samples WHERE iface = 'eth1' AND queue <> '5'")
def label_filter(spark, sf):
    rows = FL.label_filter(samples(spark, sf), {"iface": "eth1"}, absent=["source"], differ={"queue": "5"})
    return rows.select(F.unix_micros("ts").alias("us"), "name", F.col("tags")["queue"].alias("queue"), "p50")


@plan("name_filter", f"""WITH {SAMPLES} SELECT name, count(*) AS n FROM samples
WHERE name IN ('tcp_rtt_us', 'tcp_retrans_segs', 'network_receive_bytes') AND contains(name, 'tcp_') AND contains(lower(name), 'retrans') GROUP BY name""")
def name_filter(spark, sf):
    rows = FL.name_filter(samples(spark, sf), any_of=["tcp_rtt_us", "tcp_retrans_segs", "network_receive_bytes"],
                          contains="tcp_", icontains="RETRANS")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_PORTS = "SELECT (l_orderkey * 31) % 65536 AS sport, (l_partkey * 177) % 65536 AS dport FROM lineitem"


@plan("service_port", f"""SELECT sport, dport, CASE WHEN sport < 32768 AND dport < 32768 THEN least(sport, dport)
WHEN sport < 32768 THEN sport WHEN dport < 32768 THEN dport END AS port, count(*) AS n FROM ({_PORTS}) GROUP BY ALL""")
def service_port(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(((F.col("l_orderkey") * 31) % 65536).alias("sport"), ((F.col("l_partkey") * 177) % 65536).alias("dport"))
    return rows.groupBy("sport", "dport", N.service_port("sport", "dport").alias("port")).agg(F.count(F.lit(1)).alias("n"))


_STAT_SQL = """CASE l_linenumber WHEN 1 THEN 'rx' || q || '_packets' WHEN 2 THEN 'rx_queue_' || q || '_bytes' WHEN 3 THEN 'tx' || q || '_dropped'
WHEN 4 THEN 'rx_packets' WHEN 5 THEN 'tx' || q || '_buff_alloc_err' WHEN 6 THEN 'rx' || q || '_buff_alloc_err' ELSE 'port.' || q || '.rx_discards_phy' END"""


def driver_stats(spark, sf):
    q = (F.col("l_suppkey") % 64).cast("string")
    number = F.col("l_linenumber")
    name = (F.when(number == 1, F.concat(F.lit("rx"), q, F.lit("_packets"))).when(number == 2, F.concat(F.lit("rx_queue_"), q, F.lit("_bytes")))
            .when(number == 3, F.concat(F.lit("tx"), q, F.lit("_dropped"))).when(number == 4, F.lit("rx_packets"))
            .when(number == 5, F.concat(F.lit("tx"), q, F.lit("_buff_alloc_err"))).when(number == 6, F.concat(F.lit("rx"), q, F.lit("_buff_alloc_err")))
            .otherwise(F.concat(F.lit("port."), q, F.lit(".rx_discards_phy"))))
    return table(spark, sf, "lineitem").select(name.alias("stat_name"), F.col("l_quantity").cast("bigint").alias("value"))


_STATS = f"stats AS (SELECT {_STAT_SQL} AS stat_name, CAST(l_quantity AS BIGINT) AS value FROM (SELECT *, l_suppkey % 64 AS q FROM lineitem))"
_RX = r"^rx(?:_queue_)?(\d+)_(packets|bytes|dropped|buff_alloc_err)$"
_TX = r"^tx(?:_queue_)?(\d+)_(packets|bytes|dropped)$"


@plan("queue_stat_fields", f"""WITH {_STATS} SELECT left(stat_name, 2) AS direction, CAST(regexp_extract(stat_name, '(\\d+)', 1) AS INT) AS queue,
'nic/queue/' || left(stat_name, 2) || '_' || regexp_extract(stat_name, '^[rt]x(?:_queue_)?\\d+_(.*)$', 1) AS metric, CAST(sum(value) AS BIGINT) AS total
FROM stats WHERE regexp_matches(stat_name, '{_RX}') OR regexp_matches(stat_name, '{_TX}') GROUP BY ALL""")
def queue_stat_fields(spark, sf):
    rows = driver_stats(spark, sf).withColumn("f", N.queue_stat_fields("stat_name")).where(F.col("f").isNotNull())
    return rows.groupBy("f.direction", "f.queue", "f.metric").agg(F.sum("value").alias("total"))


@plan("keep_patterns", f"""WITH {_STATS} SELECT 'nic/driver/' || regexp_replace(stat_name, '[^A-Za-z0-9_]', '_', 'g') AS metric, CAST(sum(value) AS BIGINT) AS total
FROM stats WHERE contains(stat_name, 'discards_phy') GROUP BY ALL""")
def keep_patterns(spark, sf):
    return FL.keep_patterns(driver_stats(spark, sf)).groupBy("metric").agg(F.sum("value").alias("total"))


@plan("exclude_virtual", """WITH d AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'lo' WHEN 1 THEN 'veth' || s_suppkey WHEN 2 THEN 'docker0'
WHEN 3 THEN 'virbr' || s_suppkey ELSE 'eth' || s_suppkey END AS iface,
CASE s_suppkey % 4 WHEN 0 THEN 'loop' || s_suppkey WHEN 1 THEN 'zram0' WHEN 2 THEN 'ram' || s_suppkey ELSE 'sd' || s_suppkey END AS disk FROM supplier)
SELECT s_suppkey, iface, disk FROM d WHERE iface LIKE 'eth%' AND disk LIKE 'sd%'""")
def exclude_virtual(spark, sf):
    k = F.col("s_suppkey").cast("string")
    five, four = F.col("s_suppkey") % 5, F.col("s_suppkey") % 4
    iface = (F.when(five == 0, F.lit("lo")).when(five == 1, F.concat(F.lit("veth"), k)).when(five == 2, F.lit("docker0"))
             .when(five == 3, F.concat(F.lit("virbr"), k)).otherwise(F.concat(F.lit("eth"), k)))
    disk = (F.when(four == 0, F.concat(F.lit("loop"), k)).when(four == 1, F.lit("zram0")).when(four == 2, F.concat(F.lit("ram"), k))
            .otherwise(F.concat(F.lit("sd"), k)))
    rows = table(spark, sf, "supplier").select("s_suppkey", iface.alias("iface"), disk.alias("disk"))
    return FL.exclude_virtual(rows, iface="iface", disk="disk")


_FIELDS = (("Ip", "FragOKs", "ip/frag/ok"), ("Icmp", "InTimeExcds", "icmp/in_time_exceeded"), ("Tcp", "RetransSegs", "tcp/retrans/segs"),
           ("Udp", "NoPorts", "udp/no_ports"), ("TcpExt", "ListenDrops", "tcp/drop/listen"), ("Ip6", "Ip6FragOKs", "ip6/frag/ok"),
           ("Udp", "NotAField", None))


@plan("field_map", f"""WITH m(i, proto, field, metric) AS (VALUES {', '.join(f"({i}, '{p}', '{f}', {'NULL' if m is None else repr(m)})" for i, (p, f, m) in enumerate(_FIELDS))})
SELECT proto, field, metric, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM events JOIN m ON i = event_id % {len(_FIELDS)} WHERE metric IS NOT NULL GROUP BY ALL""")
def field_map(spark, sf):
    at = (F.col("event_id") % len(_FIELDS) + 1).cast("int")
    rows = events(spark, sf).select(F.element_at(F.array(*[F.lit(p) for p, _, _ in _FIELDS]), at).alias("proto"),
                                    F.element_at(F.array(*[F.lit(f) for _, f, _ in _FIELDS]), at).alias("field"), cents().alias("v"))
    return FL.field_map(rows).groupBy("proto", "field", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


_ALL_FIELDS = (*((p, f, m) for p, fields in FL.FIELD_MAP.items() for m, f in fields.items()), ("Udp", "NotAField", None))


@plan("field_map_whole", f"""WITH m(i, proto, field, metric) AS (VALUES {', '.join(f"({i}, '{p}', '{f}', {'NULL' if m is None else repr(m)})" for i, (p, f, m) in enumerate(_ALL_FIELDS))})
SELECT proto, field, metric, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM events JOIN m ON i = event_id % {len(_ALL_FIELDS)} WHERE metric IS NOT NULL GROUP BY ALL""")
def field_map_whole(spark, sf):
    """Every pair of the map, and one field that is not in it."""
    at = (F.col("event_id") % len(_ALL_FIELDS) + 1).cast("int")
    rows = events(spark, sf).select(F.element_at(F.array(*[F.lit(p) for p, _, _ in _ALL_FIELDS]), at).alias("proto"),
                                    F.element_at(F.array(*[F.lit(f) for _, f, _ in _ALL_FIELDS]), at).alias("field"), cents().alias("v"))
    return FL.field_map(rows).groupBy("proto", "field", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@plan("artifact_flags", f"""WITH s AS (SELECT event_id, {CENTS} AS p50, CASE event_id % 11 WHEN 0 THEN 549755813887 WHEN 1 THEN 1048575
ELSE {CENTS} * (1 + event_id % 3) END AS p99 FROM events)
SELECT event_id, CASE WHEN p99 IN (549755813887, 1048575) THEN 'saturated' WHEN greatest(p50, p99) > 15000 THEN 'aliasing'
WHEN greatest(p50, p99) > 10000 THEN 'tail_artifact' ELSE 'ok' END AS flag FROM s""")
def artifact_flags(spark, sf):
    n = F.col("event_id") % 11
    p99 = F.when(n == 0, F.lit(2**39 - 1)).when(n == 1, F.lit(2**20 - 1)).otherwise(cents() * (F.col("event_id") % 3 + 1))
    rows = events(spark, sf).select("event_id", cents().alias("p50"), p99.alias("p99"))
    return rows.select("event_id", N.artifact_flags("p50", "p99", F.lit(10_000)).alias("flag"))


@plan("normalize_mask", """SELECT o_orderkey, CASE WHEN m = '' THEN '0' ELSE m END AS mask FROM (SELECT o_orderkey,
regexp_replace(replace('00000000,' || lpad(lower(hex(o_orderkey // 7 * 4096)), 8, '0') || CASE WHEN o_orderkey % 9 = 0 THEN ',00000000' ELSE '' END, ',', ''), '^0+', '') AS m FROM orders)""")
def normalize_mask(spark, sf):
    word = F.lpad(F.lower(F.hex((F.floor(F.col("o_orderkey") / 7) * 4096).cast("bigint"))), 8, "0")
    mask = F.concat(F.lit("00000000,"), word, F.when(F.col("o_orderkey") % 9 == 0, F.lit(",00000000")).otherwise(F.lit("")))
    return table(spark, sf, "orders").select("o_orderkey", X.normalize_mask(mask).alias("mask"))
