"""Structured Streaming forms of the operators, and running them.

Late data does not exist in a sampling agent; here a watermark (default one
window, 60 s) bounds the state, and rows behind it are counted by
:func:`loss_metrics`, not merged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.durations import interval_text, micros
from fleetpulse.functions.h2 import KERNEL_GROUPING, WINDOW_GROUPING, WINDOW_MAX_POWER, h2_bound
from fleetpulse.functions.percentiles import event_total
from fleetpulse.operators.histograms import rollup_row
from fleetpulse.operators.joins import attribute_changes
from fleetpulse.operators.rates import ordered_long, rates_of_chain
from fleetpulse.schema import SERIES
from fleetpulse.session import scratch
from fleetpulse.streaming.changes import timeline_stream
from fleetpulse.streaming.exports import tolerant_export
from fleetpulse.streaming.processors import ConfigHistory, Durations, Expiry, KeptChain, Pairs


def _schema(df: DataFrame, keys: Sequence[str], *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])


def _tie(tie: str | None, otherwise: Column | None = None) -> Column:
    """What orders equal times; a null comes first, as in batch."""
    if tie is None:
        return (F.lit(0) if otherwise is None else otherwise).cast("bigint").alias("tie")
    return F.coalesce(F.col(tie).cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("tie")


def _late(df: DataFrame, delay) -> DataFrame:
    return df.where("ts is not null").withWatermark("ts", interval_text(delay))


def stream_window_percentiles(df: DataFrame, window="60 s", step="10 s", delay="60 s", keys: Sequence[str] = SERIES,
                              value: str = "raw", g: int = WINDOW_GROUPING, n: int = WINDOW_MAX_POWER) -> DataFrame:
    """Percentiles of sliding windows, each emitted once when the watermark passes its end.

    Readings are counted once, in the pane of one step; panes then merge into
    the windows they serve. State holds bucket counts, never readings.
    """
    if micros(window) % micros(step):
        raise ValueError("window must be a multiple of step")
    keys = list(keys)
    pane, whole = interval_text(step), interval_text(window)
    panes = (_late(df, delay).select("ts", *keys, h2_bound(value, g, n).alias("bound"))
             .groupBy(F.window("ts", pane), *keys, "bound").agg(F.count(F.lit(1)).alias("count")))
    merged = (panes.withColumn("__at", F.window_time("window")).drop("window")
              .groupBy(F.window("__at", whole, pane), *keys, "bound").agg(F.sum("count").alias("count")))
    arrays = merged.groupBy("window", *keys).agg(F.array_sort(F.collect_list(F.struct("bound", "count"))).alias("buckets"))
    return rollup_row(arrays).select("window", *keys, event_total("buckets").cast("bigint").alias("total"),
                                     "p50", "p90", "p99", "p999")


def stream_counter_rate(df: DataFrame, min_dt=0.005, keys: Sequence[str] = SERIES, value: str = "raw",
                        tie: str | None = None, delay="60 s", forget=None) -> DataFrame:
    """Counter rates with the last kept reading per series carried across micro-batches.

    A null reading is none. A reading takes effect when the watermark passes it, in event-time
    order whatever batch it came in. ``forget`` drops the last reading of a series silent for that long (default: never).
    """
    keys = list(keys)
    rows = _late(df, delay).select(*keys, "ts", F.unix_micros("ts").alias("us"),
                                   _tie(tie, ordered_long(value)), ordered_long(value).alias("value")).where("value is not null")
    long = T.LongType()
    out = _schema(rows, keys, ("us", long), ("value", long), ("prev_us", long), ("prev_value", long))
    kept = rows.groupBy(*keys).transformWithStateInPandas(
        KeptChain(keys, micros(min_dt), None if forget is None else micros(forget)), out, "append", "eventTime")
    return rates_of_chain(kept, keys)


def stream_expire(df: DataFrame, interval="100 ms", slice="100 ms", keys: Sequence[str] = SERIES,
                  buckets: str = "buckets", delay="60 s") -> DataFrame:
    """Totals of live distributions, and one empty row when a series falls silent.

    Totals come at once; a silence shows when the watermark has passed it.
    """
    keys = list(keys)
    limit = max(3 * micros(interval), 10 * micros(slice))
    rows = _late(df, delay).select(*keys, "ts", F.unix_micros("ts").alias("us"), F.lit(0).cast("bigint").alias("tie"),
                                   event_total(buckets).cast("bigint").alias("total"))
    out = _schema(rows, keys, ("us", T.LongType()), ("total", T.LongType()), ("expired", T.BooleanType()))
    return rows.groupBy(*keys).transformWithStateInPandas(Expiry(keys, limit), out, "append", "eventTime")


def stream_state_durations(df: DataFrame, entity: Sequence[str] = ("cpu",), tie: str | None = None, delay="60 s", forget=None) -> DataFrame:
    """Completed stays, in event-time order; ``forget`` drops an entry never left after that long (default: never)."""
    keys = [*entity, "span"]
    rows = _late(df, delay).select(*keys, "ts", F.unix_micros("ts").alias("us"),
                                   _tie(tie), "action", "state")
    long = T.LongType()
    out = _schema(rows, keys, ("state", T.StringType()), ("entered_us", long), ("left_us", long), ("us", long))
    return rows.groupBy(*keys).transformWithStateInPandas(
        Durations(keys, None if forget is None else micros(forget)), out, "append", "eventTime")


def stream_paired_latency(df: DataFrame, keys: Sequence[str] = ("sock",), tie: str | None = None, timeout=None,
                          delay="60 s") -> DataFrame:
    keys = list(keys)
    rows = _late(df, delay).where(F.col("action").isin("start", "end", "destroy")).select(
        *keys, "ts", F.unix_micros("ts").alias("us"), _tie(tie), "action")
    out = _schema(rows, keys, ("end_us", T.LongType()), ("us", T.LongType()))
    done = rows.groupBy(*keys).transformWithStateInPandas(
        Pairs(keys, None if timeout is None else micros(timeout)), out, "append", "eventTime")
    return done.withColumn("bound", h2_bound("us", KERNEL_GROUPING, 52))


def change_stream(snapshots: DataFrame, events: DataFrame | None = None, window: Sequence[str] = ("window_id",), delay="60 s",
                  drain="0 s") -> DataFrame:
    """Changes as snapshots (hostname, ts, snapshot, config map) arrive.

    A full snapshot is a full poll, so a missed event only delays a change. Snapshots wait for the watermark and are compared in
    event-time order; streamed ``events`` (hostname, ts, the window column, seq, pid, comm, scope, arg) are
    joined in the same state, see :func:`timeline_stream`. Without ``ts`` snapshots are taken as they come, each host's in rising order,
    an older one is no change; then static ``events`` attribute each change inside ``foreachBatch`` or here in batch.
    """
    keys = ["hostname"]
    if "ts" in snapshots.columns:
        if events is not None and not events.isStreaming:
            raise ValueError("events of timed snapshots come as a stream")
        column = window[0] if events is not None and window[0] in snapshots.columns else None
        if events is not None and column is None:
            snapshots, column = snapshots.withColumn(window[0], F.col("snapshot")), window[0]
        return timeline_stream(snapshots, events, keys, column, delay, drain)
    rows = snapshots.select(*keys, "snapshot", F.map_entries("config").alias("config"))
    text = T.StringType()
    out = _schema(rows, keys, ("snapshot", T.LongType()), ("key", text), ("old_value", text), ("new_value", text))
    changes = rows.groupBy(*keys).transformWithStateInPandas(ConfigHistory(keys), out, "append", "none")
    if events is None:
        return changes
    return attribute_changes(changes.withColumn(window[0], F.col("snapshot")), events, window)


def stream_distinct(df: DataFrame, columns: Sequence[str], delay="60 s") -> DataFrame:
    """Exact duplicates counted once while within the watermark of each other."""
    return _late(df, delay).dropDuplicatesWithinWatermark(list(columns))


def export_stream(df: DataFrame, sink: Callable[[DataFrame, int], None], every="10 seconds", *, checkpoint: str,
                  name: str = "export", drain: bool = False, on_failure: Callable[[int, Exception], None] | None = None,
                  dead_letters: str | None = None) -> StreamingQuery:
    """Push a stream to ``sink`` on its own cadence.

    A failing sink is reported to ``on_failure`` and stops the query; the batch
    is replayed from the checkpoint on restart, so nothing is lost or exported again silently.
    With a folder for ``dead_letters`` the query goes on instead: failed batches are kept there and sent again,
    and each tick records the failures so far (:mod:`fleetpulse.streaming.exports`).
    ``drain`` exports everything available and ends.
    """
    if dead_letters is not None:
        return tolerant_export(df, sink, dead_letters, every, checkpoint=checkpoint, name=name, drain=drain, on_failure=on_failure)

    def push(batch: DataFrame, batch_id: int) -> None:
        try:
            sink(batch, batch_id)
        except Exception as error:
            if on_failure is not None:
                on_failure(batch_id, error)
            raise

    writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(push)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return writer.start()


def failure_rows(spark: SparkSession, sink: str, failures: Sequence[tuple[int, str]]) -> DataFrame:
    """Export failures as rows of the observation table."""
    rows = [("exporter/sink/export_failures", {"sink": sink}, "counter", "count", i + 1) for i, _ in enumerate(failures)]
    return spark.createDataFrame(rows, "name string, labels map<string,string>, kind string, unit string, raw bigint")


def loss_metrics(query: StreamingQuery) -> DataFrame:
    """Rows behind the watermark and rows read, per micro-batch, as observations.

    Read from the progress reports that Spark still holds (the last hundred); for the whole of a run, and after it,
    use :func:`record_losses`.
    """
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    rows = []
    for progress in query.recentProgress:
        held = json.loads(progress.json) if hasattr(progress, "json") else progress
        dropped = sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in held.get("stateOperators", []))
        labels = {"query": str(held.get("name"))}
        for name, raw in (("stream/dropped_rows", dropped), ("stream/input_rows", int(held.get("numInputRows", 0)))):
            rows.append((held["timestamp"], name, labels, "gauge", "count", raw, int(held["batchId"])))
    frame = spark.createDataFrame(
        rows, "at string, name string, labels map<string,string>, kind string, unit string, raw bigint, batch bigint")
    return frame.withColumn("ts", F.to_timestamp("at")).drop("at")


def run_to_table(df: DataFrame, name: str, checkpoint: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over everything available into a table; returns the table and the finished query."""
    spark = df.sparkSession
    base = checkpoint or scratch(spark, name)
    query = (df.writeStream.queryName(name).format("parquet").outputMode("append")
             .option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table"), query
