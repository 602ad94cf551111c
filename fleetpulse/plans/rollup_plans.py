"""Queries over the roll-up table and over sessions of observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import filters as FL, rollups as A
from fleetpulse.operators.paging import page as paged
from fleetpulse.plans.adapters import (
    CENTS, CPU_SAMPLES, HOUR_US, OBS_GAUGE, SAMPLES, cents, cpu_samples, events, obs_gauge, round_sql, samples, table)
from fleetpulse.plans.registry import plan

RX, TX = A.RX, A.TX


def _gbps(x: str) -> str:
    return round_sql(f"({x}) / 1.25e8", 2)


@plan("pivot_percentiles", f"""WITH {SAMPLES} SELECT us, {', '.join(f"coalesce(max(CASE WHEN name = '{n}' THEN {c} END), 0) AS {p}_{c}" for p, n in (('rx', RX), ('tx', TX)) for c in ('p50', 'p99'))}
FROM samples WHERE name IN ('{RX}', '{TX}') GROUP BY us""")
def pivot_percentiles(spark, sf):
    out = A.pivot_percentiles(samples(spark, sf), {"rx": RX, "tx": TX}, ["p50", "p99"])
    return out.select(F.unix_micros("ts").alias("us"), "rx_p50", "rx_p99", "tx_p50", "tx_p99")


@plan("bandwidth_receive", f"""WITH {SAMPLES} SELECT us // 1000 AS t_ms, {', '.join(f"{_gbps(p)} AS {p}_gbps" for p in ('p50', 'p90', 'p99', 'p999'))}
FROM samples WHERE name = '{RX}' AND iface = 'eth1'""")
def bandwidth_receive(spark, sf):
    return A.bandwidth(samples(spark, sf), "eth1", "rx")


@plan("bandwidth_both", f"""WITH {SAMPLES} SELECT us // 1000 AS t_ms, {', '.join(f"{_gbps(f'''coalesce(max(CASE WHEN name = '{n}' THEN {c} END), 0)''')} AS {p}_{c}" for p, n in (('rx', RX), ('tx', TX)) for c in ('p50', 'p99'))}
FROM samples WHERE name IN ('{RX}', '{TX}') AND iface = 'eth2' GROUP BY us""")
def bandwidth_both(spark, sf):
    return A.bandwidth(samples(spark, sf), "eth2", "both")


_BALANCE = f"""q AS (SELECT iface, CAST(queue AS INT) AS queue, avg(p50) / 1.25e8 AS g FROM samples WHERE name = 'nic_queue_rx_bytes' GROUP BY ALL),
bal AS (SELECT iface, count(CASE WHEN g > 8 THEN 1 END) AS active, count(CASE WHEN g <= 8 THEN 1 END) AS idle, count(*) AS total,
    {round_sql('coalesce(max(CASE WHEN g > 8 THEN g END), 0)', 2)} AS hottest_gbps, {round_sql('coalesce(min(CASE WHEN g > 8 THEN g END), 0)', 2)} AS coldest_gbps,
    {round_sql('stddev_pop(CASE WHEN g > 8 THEN g END) / nullif(avg(CASE WHEN g > 8 THEN g END), 0) * 100', 1)} AS cv_pct FROM q GROUP BY iface)"""


def _balance(spark, sf):
    rows = samples(spark, sf).withColumn("iface", A.tag("iface"))
    return A.queue_balance(rows, active=8.0, by=["iface"])


@plan("queue_balance", f"WITH {SAMPLES}, {_BALANCE} SELECT * FROM bal")
def queue_balance(spark, sf):
    return _balance(spark, sf)


@plan("expected_active", f"""WITH {SAMPLES}, {_BALANCE}, f AS (SELECT iface, active, total, unnest([1, 32, 128, 256]) AS flows FROM bal)
SELECT iface, active, total, flows, {round_sql('total * (1 - pow((total - 1.0) / total, flows))', 6)} AS expected_active FROM f""")
def expected_active(spark, sf):
    flows = F.explode(F.array(*[F.lit(n) for n in (1, 32, 128, 256)])).alias("flows")
    rows = _balance(spark, sf).select("iface", "active", "total", flows)
    return A.expected_active(rows).withColumn("expected_active", F.round("expected_active", 6))


def _cores(source: str) -> str:
    cond = "source = 'ebpf'" if source == "ebpf" else "source IS NULL"
    cells = ", ".join(f"coalesce(max(CASE WHEN name = 'cpu_usage_{s}' THEN p99 END), 0) AS {s}_p99" for s in ("softirq", "system", "user"))
    return f"""WITH {CPU_SAMPLES} SELECT cpu, {cells} FROM cpus WHERE {cond} AND cpu <> 'cpu' GROUP BY cpu
ORDER BY softirq_p99 DESC, cpu LIMIT 5"""


@plan("busiest_cores", _cores("procfs"))
def busiest_cores(spark, sf):
    return A.busiest_cores(cpu_samples(spark, sf), "procfs", 5)


@plan("busiest_cores_ebpf", _cores("ebpf"))
def busiest_cores_ebpf(spark, sf):
    return A.busiest_cores(cpu_samples(spark, sf), "ebpf", 5)


@plan("flow_health", f"""WITH {SAMPLES} SELECT name, {round_sql('avg(p50)', 0)} AS avg_p50, CAST(max(p99) AS DOUBLE) AS max_p99, count(*) AS samples
FROM samples WHERE name IN ('tcp_rtt_us', 'tcp_retransmits', 'tcp_retrans_segs') GROUP BY name""")
def flow_health(spark, sf):
    return A.flow_health(samples(spark, sf))


@plan("metric_catalog", f"""WITH {SAMPLES} SELECT name, count(*) AS samples, 'iface,queue' AS tag_keys FROM samples WHERE contains(name, 'network') GROUP BY name""")
def metric_catalog(spark, sf):
    return A.metric_catalog(samples(spark, sf), "network").withColumn("tag_keys", F.array_join("tag_keys", ","))


@plan("session_overview", f"""WITH {OBS_GAUGE} SELECT count(*) AS rows, count(DISTINCT name) AS metrics, count(DISTINCT (name, labels_key, kind, unit)) AS series,
min(us) AS first_us, max(us) AS last_us FROM obs""")
def session_overview(spark, sf):
    out = A.session_overview(obs_gauge(spark, sf))
    return out.select("rows", "metrics", "series", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@plan("label_facets", f"""WITH {SAMPLES}, s AS (SELECT * FROM samples WHERE name = 'tcp_rtt_us')
SELECT 'iface' AS label_key, iface AS label_value, count(*) AS rows FROM s GROUP BY ALL UNION ALL SELECT 'queue', queue, count(*) FROM s GROUP BY ALL""")
def label_facets(spark, sf):
    return A.label_facets(samples(spark, sf), "tcp_rtt_us", "tags")


@plan("kind_unit_shapes", """SELECT DISTINCT event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'counter' END AS kind, 'unit' || user_id % 3 AS unit,
upper(CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'counter' END || ' · ' || 'unit' || user_id % 3) AS caption FROM events""")
def kind_unit_shapes(spark, sf):
    rows = obs_gauge(spark, sf).select(
        F.col("event_type").alias("name"), F.when(F.col("event_id") % 2 == 0, "gauge").otherwise("counter").alias("kind"),
        F.concat(F.lit("unit"), (F.col("user_id") % 3).cast("string")).alias("unit"))
    return A.kind_unit_shapes(rows)


@plan("sum_over_label", f"""WITH {SAMPLES} SELECT us, name, '{{"iface":"' || iface || '"}}' AS labels_key, CAST(sum(raw) AS BIGINT) AS raw FROM samples GROUP BY ALL""")
def sum_over_label(spark, sf):
    out = A.sum_over_label(samples(spark, sf), "queue", "tags")
    return out.select(F.unix_micros("ts").alias("us"), "name", "labels_key", F.col("raw").cast("bigint").alias("raw"))


@plan("panel_stats", f"""WITH {OBS_GAUGE}, v AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE raw END AS value FROM obs)
SELECT labels_key, arg_max(value, us) FILTER (WHERE value IS NOT NULL) AS last, max(value) AS max, min(value) AS min, min(us) AS first_us, max(us) AS last_us FROM v GROUP BY labels_key""")
def panel_stats(spark, sf):
    rows = obs_gauge(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("raw")))
    out = A.panel_stats(rows)
    return out.select("labels_key", "last", "max", "min", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


def _tuples(spark, sf):
    labels = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))).otherwise(
        F.create_map(F.lit("cpu"), F.lit("0")))
    return obs_gauge(spark, sf).select(F.col("event_type").alias("name"), labels.alias("labels"), "kind", "unit", "event_id")


_TUPLES = f"""WITH {OBS_GAUGE}, t AS (SELECT DISTINCT event_type AS name, CASE WHEN user_id % 3 = 0 THEN 'a,z' ELSE 'cpu' END AS label_keys, kind, unit FROM obs)"""


@plan("coverage_tuples", f"{_TUPLES} SELECT * FROM t")
def coverage_tuples(spark, sf):
    return A.coverage_tuples(_tuples(spark, sf)).withColumn("label_keys", F.array_join("label_keys", ","))


@plan("coverage_gate", f"{_TUPLES} SELECT * FROM t WHERE name IN ('view', 'error') AND label_keys = 'cpu'")
def coverage_gate(spark, sf):
    golden = A.coverage_tuples(_tuples(spark, sf))
    live = golden.where(~(F.col("name").isin("view", "error") & F.array_contains("label_keys", "cpu")))
    return A.coverage_gate(golden, live).withColumn("label_keys", F.array_join("label_keys", ","))


@plan("time_bucket_max", f"""WITH {SAMPLES} SELECT name, us - us % {24 * HOUR_US} AS bucket, max(p99) AS max_p99 FROM samples GROUP BY ALL""")
def time_bucket_max(spark, sf):
    return A.time_bucket_max(samples(spark, sf), "1 day").withColumn("bucket", F.unix_micros("bucket"))


@plan("peak_by_label", f"""WITH {SAMPLES} SELECT queue, max(p99) AS peak FROM samples WHERE name = 'nic_queue_rx_bytes' AND iface = 'eth1' GROUP BY queue""")
def peak_by_label(spark, sf):
    rows = FL.label_filter(FL.name_filter(samples(spark, sf), equal="nic_queue_rx_bytes"), {"iface": "eth1"})
    return A.peak_by_label(rows)


@plan("page", f"""WITH {OBS_GAUGE}, r AS (SELECT us, labels_key, raw, row_number() OVER (ORDER BY us, labels_key, raw) - 1 AS row FROM obs)
SELECT us, labels_key, raw, row FROM r WHERE row BETWEEN 350 AND 399""")
def page(spark, sf):
    return paged(obs_gauge(spark, sf), 7, 50, chunk="1 day").select(F.unix_micros("ts").alias("us"), "labels_key", "raw", F.col("row").cast("bigint").alias("row"))


@plan("page_clamped", f"""WITH {OBS_GAUGE}, r AS (SELECT us, labels_key, raw, row_number() OVER (ORDER BY us, labels_key, raw) - 1 AS row, count(*) OVER () AS n FROM obs)
SELECT us, labels_key, raw, row FROM r WHERE row >= (n - 1) // 50 * 50""")
def page_clamped(spark, sf):
    return paged(obs_gauge(spark, sf), 10**9, 50, chunk="1 day").select(F.unix_micros("ts").alias("us"), "labels_key", "raw", F.col("row").cast("bigint").alias("row"))


@plan("page_in_ties", f"""WITH t AS (SELECT user_id % 3 AS day, event_type AS labels_key, {CENTS} AS raw, event_id FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY day, labels_key, raw, event_id) - 1 AS row, count(*) OVER () AS n FROM t)
SELECT day, labels_key, raw, event_id, row FROM r WHERE row >= n // 2 // 200 * 200 AND row < n // 2 // 200 * 200 + 200""")
def page_in_ties(spark, sf):
    """The middle page where a third of all rows share each time: narrowed by the other columns, few rows sorted."""
    rows = events(spark, sf).select(F.timestamp_seconds((F.col("user_id") % 3) * 86400).alias("ts"), F.col("event_type").alias("labels_key"),
                                    cents().alias("raw"), "event_id")
    middle = rows.count() // 2 // 200
    out = paged(rows, middle, 200, chunk="1 day", few=2000)
    return out.select((F.unix_seconds("ts") / 86400).cast("bigint").alias("day"), "labels_key", F.col("raw").cast("bigint").alias("raw"), "event_id", "row")


@plan("distinct_names", """SELECT DISTINCT p_name || '/' || p_type AS name FROM part WHERE contains(lower(p_name || '/' || p_type), 'ring/e')""")
def distinct_names(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_name", F.lit("/"), "p_type").alias("name"))
    return A.distinct_names(rows, "RING/E")


@plan("adhoc_view", f"""WITH {SAMPLES} SELECT iface, name, max(p99) AS peak, count(*) AS n FROM samples GROUP BY iface, name""")
def adhoc_view(spark, sf):
    A.register_views(spark, fleet_samples=samples(spark, sf))
    return spark.sql("""WITH s AS (SELECT tags['iface'] AS iface, name, p99 FROM fleet_samples)
        SELECT iface, name, max(p99) AS peak, count(*) AS n FROM s GROUP BY iface, name""")
