"""Streams over several micro-batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse import (
    bucket_array, change_stream, config_diff, counter_rate, export_stream, failure_rows, loss_metrics, paired_latency, rollup_row, run_to_table,
    slice_histogram, sliding_histogram, state_durations, stream_counter_rate, stream_distinct, stream_expire, stream_paired_latency,
    stream_state_durations, stream_window_percentiles)

BASE = 1_704_067_200_000_000
SCHEMA = "name string, labels_key string, us bigint, i bigint, raw bigint, action string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve files, each a micro-batch, rows up to 20 s out of order; a last row moves the watermark past all."""
    rnd, rows, t = random.Random(9), [], BASE
    totals = {"a": 0, "b": 0}
    for i in range(1200):
        t += rnd.randint(1, 120_000)
        k = "a" if rnd.random() < 0.7 else "b"
        totals[k] = totals[k] + rnd.randint(0, 50) if rnd.random() < 0.99 else 0
        rows.append(("m", k, t, i, totals[k], rnd.choice(["start", "end", "destroy", "other"])))
    rows.sort(key=lambda r: r[2] + rnd.randint(0, 20_000_000))
    path = tmp_path_factory.mktemp("stream")
    for n in range(12):
        part = spark.createDataFrame(rows[n * 100:(n + 1) * 100], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(path))
    end = [("m", "closing", t + 600_000_000, 1200, 0, "start")]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder).where("labels_key != 'closing'").withColumn("ts", F.timestamp_micros("us"))


def stream(spark, folder):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_micros("us")))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counter_rate(spark, folder, tmp_path):
    want = counter_rate(batch(spark, folder), 0.2, tie="i", chunk="5 s").select("labels_key", "ts", "raw", "rate")
    out, query = run_to_table(stream_counter_rate(stream(spark, folder), 0.2, tie="i"), "rates", str(tmp_path))
    assert rows(out.select("labels_key", "ts", "raw", "rate")) == rows(want)
    assert query.lastProgress["batchId"] >= 11, "several micro-batches"


def test_window_percentiles(spark, folder, tmp_path):
    slices = slice_histogram(batch(spark, folder), "1 s")
    want = rollup_row(bucket_array(sliding_histogram(slices, "10 s", "2 s", "1 s")))
    out, _ = run_to_table(stream_window_percentiles(stream(spark, folder), "10 s", "2 s"), "windows", str(tmp_path))
    got = rows(out.select("labels_key", (F.unix_micros("window.end") / 1_000_000 - 1).cast("bigint"), "p50", "p90", "p99", "p999"))
    full = rows(want.select("labels_key", "window_slice", "p50", "p90", "p99", "p999"))
    assert len(got) > 20 and set(full) <= set(got)
    # Batch windows end within the data; the stream also gives the ones that reach past its end.
    newest = max(r[1] for r in full)
    assert {g for g in got if g[1] <= newest} == set(full)


def test_silence_expires_a_series(spark, tmp_path):
    for n, items in enumerate(([("a", 0), ("b", 0)], [("a", 40)], [("a", 80)], [("a", 200)])):
        df = spark.createDataFrame([(k, BASE + s * 1_000_000) for k, s in items], "labels_key string, us bigint").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("labels_key string, us bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source = source.withColumns({"ts": F.timestamp_micros("us"), "name": F.lit("m"),
                                 "buckets": F.array(F.struct(F.lit(1).cast("bigint").alias("bound"), F.lit(5).cast("bigint").alias("count")))})
    out, _ = run_to_table(stream_expire(source, "10 s", "100 ms", delay="0 seconds"), "expire", str(tmp_path / "out"))
    got = {(r.labels_key, (r.us - BASE) // 1_000_000, r.total, r.expired) for r in out.collect()}
    # Every silence longer than the limit shows, however the rows fall into batches.
    assert {g for g in got if g[3]} == {("b", 30, 0, True), ("a", 30, 0, True), ("a", 70, 0, True), ("a", 110, 0, True)}
    assert {g for g in got if not g[3]} == {("a", 0, 5, False), ("b", 0, 5, False), ("a", 40, 5, False), ("a", 80, 5, False), ("a", 200, 5, False)}


def fed(spark, folder, batches, schema):
    """One file per micro-batch, and a last one that moves the watermark past all."""
    first = batches[0][0]
    closing = [("closing", BASE + 10_000_000_000, *first[2:])]
    for items in [*[[(k, BASE + s * 1_000_000, *rest) for k, s, *rest in items] for items in batches], closing]:
        spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_micros("us"))


def test_rows_out_of_order_between_batches(spark, tmp_path):
    second = lambda c: ((F.col(c) - BASE) / 1_000_000).cast("bigint")
    schema = "labels_key string, us bigint, action string"
    pairs = fed(spark, f"{tmp_path}/p", [[("a", 10, "start")], [("a", 40, "end")], [("a", 35, "destroy")]], schema)
    out, _ = run_to_table(stream_paired_latency(pairs, ["labels_key"]), "p", f"{tmp_path}/po")
    assert rows(out) == []

    stays = fed(spark, f"{tmp_path}/d", [[("a", 10, "enter")], [("a", 40, "leave")], [("a", 35, "leave")]], schema)
    stays = stays.withColumns({"cpu": F.col("labels_key"), "span": F.lit("idle"), "state": F.lit("idle")})
    out, _ = run_to_table(stream_state_durations(stays), "d", f"{tmp_path}/do")
    assert rows(out.select("cpu", second("entered_us"), second("left_us"), "us")) == [("a", 10, 35, 25_000_000)]

    counts = fed(spark, f"{tmp_path}/c", [[("a", 0, 0), ("a", 10, 10), ("a", 20, 30)], [("a", 15, 20), ("a", 40, 90)], [("a", 25, 35), ("a", 30, 40)]],
                 "labels_key string, us bigint, raw bigint").withColumn("name", F.lit("m"))
    out, query = run_to_table(stream_counter_rate(counts, 5), "c", f"{tmp_path}/co")
    assert rows(out.select(second("us") if "us" in out.columns else ((F.unix_micros("ts") - BASE) / 1_000_000).cast("bigint"), F.col("rate").cast("bigint"))) == [
        (10, 1), (15, 2), (20, 2), (25, 1), (30, 1), (40, 5)]

    series = fed(spark, f"{tmp_path}/e", [[("a", 100)], [("a", 50), ("a", 200)]], "labels_key string, us bigint").withColumns(
        {"name": F.lit("m"), "buckets": F.array(F.struct(F.lit(1).cast("bigint").alias("bound"), F.lit(5).cast("bigint").alias("count")))})
    out, _ = run_to_table(stream_expire(series, "20 s", "100 ms", delay="200 s"), "e", f"{tmp_path}/eo")
    assert rows(out.where("expired").select("labels_key", second("us"))) == [("a", 160), ("a", 260)]


def test_forgotten_readings(spark, tmp_path):
    counts = fed(spark, f"{tmp_path}/c", [[("a", 0, 0), ("a", 10, 10)], [("b", 500, 0)], [("a", 600, 700), ("a", 610, 720)]],
                 "labels_key string, us bigint, raw bigint").withColumn("name", F.lit("m"))
    out, _ = run_to_table(stream_counter_rate(counts, 5, forget="60 s"), "c", f"{tmp_path}/co")
    assert rows(out.select("labels_key", F.col("rate").cast("bigint"))) == [("a", 1), ("a", 2)]


def test_pairs(spark, folder, tmp_path):
    want = paired_latency(batch(spark, folder), ["labels_key"], order=["ts", "i"], chunk="5 s")
    out, _ = run_to_table(stream_paired_latency(stream(spark, folder), ["labels_key"], tie="i"), "pairs", str(tmp_path))
    assert rows(out.select("labels_key", "end_us", "us", "bound")) == rows(want.select("labels_key", F.unix_micros("ts"), "us", "bound"))


def test_stays(spark, folder, tmp_path):
    def shape(df):
        return df.select("labels_key", "ts", "i", F.lit("idle").alias("span"), F.when(F.col("action") == "start", "enter").otherwise("leave").alias("action"),
                         F.when(F.col("i") % 2 == 0, "idle").otherwise("iowait").alias("state"))

    want = state_durations(shape(batch(spark, folder)), ["labels_key"], order=["ts", "i"], chunk="5 s")
    out, _ = run_to_table(stream_state_durations(shape(stream(spark, folder)), ["labels_key"], tie="i"), "stays", str(tmp_path))
    assert rows(out.select("labels_key", "state", "left_us", "us")) == rows(want.select("labels_key", "state", F.unix_micros("ts"), "us"))


def test_changes(spark, tmp_path):
    rnd = random.Random(4)
    for n in range(6):
        snap = [(h, n, {k: str(rnd.randint(0, 2)) for k in "abcd" if rnd.random() < 0.8}) for h in ("h1", "h2")]
        spark.createDataFrame(snap, "hostname string, snapshot bigint, config map<string,string>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    want = config_diff(static.select("hostname", "snapshot", F.explode("config").alias("key", "value")))
    source = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, _ = run_to_table(change_stream(source), "changes", str(tmp_path / "out"))
    columns = ["hostname", "snapshot", "key", "old_value", "new_value"]
    assert rows(out.select(*columns)) == rows(want.select(*columns)) != []


def test_duplicates_across_batches(spark, folder, tmp_path):
    source = stream(spark, folder).withColumn("k", F.col("i") % 50)
    out, _ = run_to_table(stream_distinct(source, ["labels_key", "k"], "1 hour"), "distinct", str(tmp_path))
    assert out.where("labels_key != 'closing'").count() == batch(spark, folder).select("labels_key", (F.col("i") % 50)).distinct().count()


def test_losses_are_metrics(spark, tmp_path):
    for n, seconds in enumerate(([0, 100], [105, 200], [5, 300], [6, 400])):
        df = spark.createDataFrame([(BASE + s * 1_000_000,) for s in seconds], "us bigint").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("us bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("us"))
    counted = source.withWatermark("ts", "10 seconds").groupBy(F.window("ts", "10 seconds")).count()
    _, query = run_to_table(counted, "losses", str(tmp_path / "out"))
    sums = {r.name: r.n for r in loss_metrics(query).groupBy("name").agg(F.sum("raw").alias("n")).collect()}
    assert sums["stream/input_rows"] == 8 and sums["stream/dropped_rows"] == 2


def test_failing_sink_is_reported_and_replayed(spark, folder, tmp_path):
    failures, seen = [], []

    def sink(df, batch_id):
        if batch_id == 1 and not failures:
            raise RuntimeError("sink down")
        seen.append((batch_id, df.count()))

    def start():
        return export_stream(stream(spark, folder), sink, checkpoint=str(tmp_path / "cp"), drain=True,
                             on_failure=lambda b, e: failures.append((b, str(e))))

    with pytest.raises(Exception, match="sink down"):
        start().awaitTermination()
    start().awaitTermination()
    assert failures == [(1, "sink down")]
    assert sum(n for _, n in seen) == 1201 and len({b for b, _ in seen}) == len(seen)
    r = failure_rows(spark, "table", failures).first()
    assert (r.name, r.raw, r.labels) == ("exporter/sink/export_failures", 1, {"sink": "table"})
