"""Streaming queries run over everything available and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions.text import encode_labels
from fleetpulse.plans.adapters import (
    ACTION_OF_EVENT, CENTS, CHANGE_EVENTS, CONFIG_OBS, DAY_US, DIFF, FIRST_WEEK, HOUR_US, OBS_GAUGE, WEEK_US, WEEKS, bound_sql, cents,
    change_events, config_obs, percentiles_sql, table)
from fleetpulse.plans.config_plans import _ATTRIBUTED
from fleetpulse.plans.rate_plans import _chain_sql
from fleetpulse.plans.registry import plan
from fleetpulse.plans.span_plans import _PAIRS, _STATES
from fleetpulse.session import scratch
from fleetpulse.streaming import streams as S
from fleetpulse.streaming.exports import export_ticks, failure_counter
from fleetpulse.streaming.losses import record_losses, recorded_losses


def event_stream(spark, sf, closed=False):
    """The events table as a stream of files; ``closed``: with one row of user -1 a hundred days
    after the newest event, which moves the watermark past all others."""
    events = table(spark, sf, "events")
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    if closed:
        newest = events.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"))
        end = newest.select(*[F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else
                              F.lit({"user_id": -1, "event_id": 0, "event_type": "closing"}.get(f.name)).cast(f.dataType).alias(f.name)
                              for f in events.schema])
        folder = scratch(spark, "closing")
        end.write.parquet(folder)
        rows = rows.unionByName(spark.readStream.schema(end.schema).parquet(folder))
    labels = F.create_map(F.lit("event_type"), F.col("event_type"))
    return rows.withColumns({"ts": F.col("ts").cast("timestamp"), "name": F.lit("event/value"), "labels_key": encode_labels(labels),
                             "raw": cents()})


_WINDOWS = f"""w AS (SELECT event_type, unnest(range(us - us % {6 * HOUR_US} - {18 * HOUR_US}, us - us % {6 * HOUR_US} + 1, {6 * HOUR_US})) AS start_us, raw FROM obs),
wb AS (SELECT event_type, start_us, {bound_sql('raw')} AS bound, count(*) AS c FROM w GROUP BY ALL),
cm AS (SELECT *, sum(c) OVER (PARTITION BY event_type, start_us ORDER BY bound) AS cum, sum(c) OVER (PARTITION BY event_type, start_us) AS n FROM wb)"""


@plan("stream_window_percentiles", f"""WITH {OBS_GAUGE}, {_WINDOWS}
SELECT event_type, start_us, CAST(max(n) AS BIGINT) AS total, {percentiles_sql()} FROM cm GROUP BY event_type, start_us""")
def stream_window_percentiles(spark, sf):
    stream = S.stream_window_percentiles(event_stream(spark, sf, closed=True), "24 hours", "6 hours", keys=["event_type"])
    out, _ = S.run_to_table(stream, "window_percentiles")
    return out.select("event_type", F.unix_micros("window.start").alias("start_us"), "total", "p50", "p90", "p99", "p999")


def _stream_counters(spark, sf):
    # Cumulative readings: the event number within the whole table, back to zero now and then.
    return event_stream(spark, sf, closed=True).withColumn("raw", F.col("event_id") % 997)


_COUNTER_CHAIN = _chain_sql(HOUR_US, True).split("o AS (", 1)[1]


@plan("stream_counter_rate", f"""WITH RECURSIVE counters AS (SELECT epoch_us(ts) AS us, event_id, event_type, event_id % 997 AS raw FROM events),
o AS ({_COUNTER_CHAIN}""")
def stream_counter_rate(spark, sf):
    stream = S.stream_counter_rate(_stream_counters(spark, sf), "1 hour", ["event_type"], tie="event_id")
    out, _ = S.run_to_table(stream, "counter_rate")
    return out.select("event_type", F.unix_micros("ts").alias("us"), F.col("raw").cast("bigint").alias("raw"),
                      F.col("rate").cast("bigint").alias("rate"))


@plan("stream_expire", f"""WITH {OBS_GAUGE}, l AS (SELECT user_id, max(us) AS last FROM obs GROUP BY ALL)
SELECT user_id, us, 1 AS total, false AS expired FROM obs UNION ALL
SELECT user_id, us + {36 * HOUR_US}, 0, true FROM (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS next FROM obs) WHERE next - us > {36 * HOUR_US} UNION ALL
SELECT user_id, last + {36 * HOUR_US}, 0, true FROM l""")
def stream_expire(spark, sf):
    one = F.array(F.struct(F.col("raw").alias("bound"), F.lit(1).cast("bigint").alias("count")))
    stream = S.stream_expire(event_stream(spark, sf, closed=True).withColumn("buckets", one), "12 hours", "1 hour", ["user_id"])
    out, _ = S.run_to_table(stream, "expire")
    return out.where("user_id >= 0").select("user_id", "us", "total", "expired")


@plan("stream_state_durations", f"WITH {_STATES} SELECT cpu, span, state, entered_us, left_us, us FROM du")
def stream_state_durations(spark, sf):
    n = F.col("event_id") % 3
    rows = event_stream(spark, sf, closed=True).select(
        (F.col("user_id") % 8).alias("cpu"), "ts", "event_id", F.when(F.col("user_id") % 2 == 0, "idle").otherwise("irq").alias("span"),
        F.when(n == 0, "leave").otherwise("enter").alias("action"), F.when(n == 1, "iowait").otherwise("idle").alias("state"))
    out, _ = S.run_to_table(S.stream_state_durations(rows, tie="event_id"), "state_durations")
    return out


@plan("stream_paired_latency", f"WITH {_PAIRS} SELECT user_id, end_us, us, {bound_sql('us', 3)} AS bound FROM lat")
def stream_paired_latency(spark, sf):
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_OF_EVENT.items() for x in kv]), F.col("event_type"))
    rows = event_stream(spark, sf, closed=True).withColumn("action", F.coalesce(action, F.lit("start")))
    out, _ = S.run_to_table(S.stream_paired_latency(rows, ["user_id"], tie="event_id"), "paired_latency")
    return out


def _in_turns(spark, rows, turn, turns, name):
    """``rows`` as a stream of ``turns`` files, one a micro-batch, by the column expression ``turn`` (0 to turns - 1), and a last
    file of one row of host or type 'closing' a thousand weeks on."""
    source = scratch(spark, name)
    held = scratch(spark, f"{name}-held")
    rows.withColumn("__turn", turn).write.partitionBy("__turn").parquet(held)
    for k in range(turns):
        spark.read.schema(rows.schema).parquet(f"{held}/__turn={k}").coalesce(1).write.mode("append").parquet(source)
    far = rows.agg((F.max("ts") + F.expr("INTERVAL 7000 DAYS")).alias("ts"))
    given = {"hostname": "closing", "snapshot": 0, "window_id": 0, "scope": "link", "seq": 0, "pid": 0,
             "event_type": "closing", "event_id": 0}
    closing = far.select(*[F.col("ts") if f.name == "ts" else F.create_map().cast(f.dataType).alias(f.name) if f.name == "config" else
                           F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    closing.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _polls(spark, sf):
    """Weekly snapshots, one row per host and week; of every three hosts one reports a week late, one two weeks."""
    maps = config_obs(spark, sf).groupBy("hostname", "snapshot").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("config"))
    return maps.withColumn("ts", F.timestamp_micros((F.col("snapshot") + 1) * WEEK_US))


def _turn(week):
    """Which of three files a row comes in: by its week, moved by up to two weeks by its host."""
    late = week + F.pmod(F.hash("hostname"), F.lit(3)) - FIRST_WEEK
    return F.greatest(F.least(F.floor(late * 3 / WEEKS), F.lit(2)), F.lit(0)).cast("int")


@plan("stream_counter_rate_files", f"""WITH RECURSIVE counters AS (SELECT epoch_us(ts) AS us, event_id, event_type, event_id % 997 AS raw FROM events),
o AS ({_COUNTER_CHAIN}""")
def stream_counter_rate_files(spark, sf):
    # Three micro-batches, rows up to two days late at their edges: a key's rows wait in runs, and each timer reads those it has passed.
    events = table(spark, sf, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")) + 1).first()
    first, end = (0, 1) if ends[0] is None else ends
    come = F.unix_micros("ts") + F.pmod(F.hash("event_id"), F.lit(3)) * DAY_US - F.lit(first)
    turn = F.least(F.floor(come * 3 / F.lit(end - first)), F.lit(2)).cast("int")
    files = _in_turns(spark, events, turn, 3, "counter_files")
    stream = S.stream_counter_rate(files.withColumn("raw", F.col("event_id") % 997), "1 hour", ["event_type"], tie="event_id", delay="3 days")
    out, _ = S.run_to_table(stream, "counter_rate_files")
    return out.select("event_type", F.unix_micros("ts").alias("us"), F.col("raw").cast("bigint").alias("raw"),
                      F.col("rate").cast("bigint").alias("rate"))


@plan("change_stream", f"WITH {CONFIG_OBS}{DIFF} SELECT hostname, snapshot, key, old_value, new_value FROM diff")
def change_stream(spark, sf):
    # Files of a third of the weeks each; at their edges snapshots come out of order, two weeks at most.
    stream = _in_turns(spark, _polls(spark, sf), _turn(F.col("snapshot")), 3, "config_snapshots")
    out, _ = S.run_to_table(S.change_stream(stream, delay="28 days"), "change_stream")
    return out


_HOST_CLAIMS = CHANGE_EVENTS.replace("AS window_id,", "AS window_id, CAST(user_id % 20 AS VARCHAR) AS hostname,", 1)
_OF_HOST = _ATTRIBUTED.replace("a.window_id = d.snapshot", "a.window_id = d.snapshot AND a.hostname = d.hostname", 1)


@plan("change_stream_attributed", f"WITH {CONFIG_OBS}{DIFF}, {_HOST_CLAIMS}, {_OF_HOST} SELECT * FROM named")
def change_stream_attributed(spark, sf):
    claims = change_events(spark, sf).withColumns({
        "hostname": (F.col("pid") % 20).cast("string"), "ts": F.timestamp_micros(F.col("window_id") * WEEK_US + F.col("seq") % WEEK_US)})
    polls = _in_turns(spark, _polls(spark, sf).withColumn("window_id", F.col("snapshot")), _turn(F.col("snapshot")), 3, "polls")
    stream = _in_turns(spark, claims, _turn(F.col("window_id")), 3, "claims")
    out, _ = S.run_to_table(S.change_stream(polls, stream, delay="28 days"), "change_stream_attributed")
    return out


@plan("stream_distinct", "SELECT DISTINCT event_type, epoch_us(ts) // 86400000000 AS day, user_id FROM events")
def stream_distinct(spark, sf):
    day = F.floor(F.unix_micros("ts") / F.lit(DAY_US)).alias("day")
    # One day's duplicates share a time, so they lie within the watermark.
    rows = event_stream(spark, sf).select("event_type", day, "user_id").withColumn("ts", F.timestamp_micros(F.col("day") * DAY_US))
    out, _ = S.run_to_table(S.stream_distinct(rows, ["event_type", "day", "user_id"], "31 days"), "distinct")
    return out.select("event_type", "day", "user_id")


@plan("loss_metrics", "SELECT 'stream/input_rows' AS name, count(*) AS raw FROM events UNION ALL SELECT 'stream/dropped_rows', 0")
def loss_metrics(spark, sf):
    rows = event_stream(spark, sf).withWatermark("ts", "1 minute").groupBy(F.window("ts", "1 day"), "event_type").count()
    reports = scratch(spark, "losses")
    recorder = record_losses(spark, reports)
    try:
        _, query = S.run_to_table(rows, "loss")
        recorder.wait_for(query)
    finally:
        spark.streams.removeListener(recorder)
    own = recorded_losses(spark, reports).where(F.col("labels")["query"] == "loss")
    return own.groupBy("name").agg(F.sum("raw").alias("raw"))


@plan("export_failures", f"""SELECT 'exporter/sink/export_failures' AS name, CAST(tick AS VARCHAR) AS label, CAST(failures AS BIGINT) AS raw, CAST(pending AS BIGINT) AS pending
FROM (VALUES (0, 0, 0), (1, 1, 1), (2, 1, 0), (3, 2, 1), (4, 2, 0)) t(tick, failures, pending)
UNION ALL SELECT 'exported/cents', event_type, CAST(sum({CENTS}) AS BIGINT), count(*) FROM events GROUP BY event_type""")
def export_failures(spark, sf):
    """A sink that refuses its second and fourth batch at first: the counter at every tick, and what it has in the end."""
    rows = event_stream_in(spark, sf, 5).select("event_type", "raw")
    path, letters, refused = scratch(spark, "export"), scratch(spark, "dead-letters"), {1, 3}

    def sink(batch, batch_id):
        if batch_id in refused:
            refused.remove(batch_id)
            raise ConnectionError("sink down")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    S.export_stream(rows, sink, checkpoint=scratch(spark, "export-checkpoint"), drain=True, dead_letters=letters).awaitTermination()
    counted = failure_counter(spark, letters, "table").join(export_ticks(spark, letters).select("tick", "pending"), "tick").select(
        "name", F.col("tick").cast("string").alias("label"), "raw", "pending")
    taken = spark.read.schema("event_type string, raw bigint, batch int").parquet(path).groupBy("event_type").agg(
        F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("pending"))
    return counted.unionByName(taken.select(F.lit("exported/cents").alias("name"), F.col("event_type").alias("label"), "raw", "pending"))


def event_stream_in(spark, sf, files):
    """The events as a stream of so many files, one a micro-batch."""
    source = scratch(spark, "event-files")
    table(spark, sf, "events").repartition(files, F.col("event_id") % files, F.col("event_id")).write.parquet(source)
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("raw", cents())


@plan("export_stream", f"SELECT event_type, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM events GROUP BY event_type")
def export_stream(spark, sf):
    path = scratch(spark, "export")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    S.export_stream(event_stream(spark, sf).select("event_type", "raw"), sink, checkpoint=scratch(spark, "export-checkpoint"), drain=True).awaitTermination()
    return (spark.read.schema("event_type string, raw bigint, batch int").parquet(path)
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total")))
