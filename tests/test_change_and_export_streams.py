"""Change streams with a stream of events, exports that go on, losses of a whole run."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse import (
    attribute_changes, change_stream, change_timeline, export_stream, export_ticks, failure_counter, pending_batches, record_losses,
    recorded_losses, replay_dead_letters, run_to_table)

BASE = 1_704_067_200_000_000
POLL = "hostname string, ts timestamp, snapshot bigint, window_id bigint, config map<string,string>"
CLAIM = "hostname string, ts timestamp, window_id bigint, seq bigint, pid bigint, comm string, scope string, arg string"
KEYS = ["sysctl.tcp_rmem_max", "ring.eth0.rx", "mtu.eth0", "rps.eth1.rx-0", "sysctl.conf.eth0.rp_filter"]
SCOPES = [("sysctl", "tcp_rmem"), ("sysctl", "rp_filter"), ("sysctl", ""), ("iface", "eth0"), ("iface", None), ("ethtool_any", None), ("steering", None), ("link", "x")]
COLUMNS = ["hostname", "snapshot", "key", "old_value", "new_value", "pid", "comm"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def at(seconds):
    from datetime import datetime, timezone
    return datetime.fromtimestamp(BASE / 1e6 + seconds, timezone.utc)


def in_files(spark, path, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def history():
    """Forty polls of two hosts, and events; the order of arrival is off by up to 60 s. One event comes far too late."""
    rnd, polls, claims = random.Random(11), [], []
    for n in range(40):
        for h in ("h1", "h2"):
            config = {k: str(rnd.randint(0, 2)) for k in KEYS if rnd.random() < 0.85}
            if n == 7:
                config[KEYS[2]] = None
            polls.append((h, at(20 * n + 19), n, n, config))
            for _ in range(rnd.randint(0, 4)):
                scope, arg = rnd.choice(SCOPES)
                seq = len(claims)
                claims.append((h, at(20 * n + rnd.randint(0, 19)), n, seq, rnd.randint(1, 99), f"c{seq % 5}", scope, arg))
    return polls, claims


def shuffled(items, files, seed):
    """In files; a row comes up to 50 s after its time."""
    rnd = random.Random(seed)
    order = sorted(items, key=lambda r: r[1].timestamp() + rnd.random() * 50)
    size = -(-len(order) // files)
    return [order[i:i + size] for i in range(0, len(order), size)]


def test_streamed_changes_are_those_of_the_batch(spark, history, tmp_path):
    polls, claims = history
    table = spark.createDataFrame(polls, POLL).select("hostname", "snapshot", "window_id", F.explode("config").alias("key", "value"))
    want = change_timeline(table, spark.createDataFrame(claims, CLAIM), ["hostname", "window_id"]).select(*COLUMNS)
    end = [("closing", at(9000), 0, 0, {})]
    stream = in_files(spark, f"{tmp_path}/polls", [*shuffled(polls, 4, 1), end], POLL)
    events = in_files(spark, f"{tmp_path}/claims", [*shuffled(claims, 4, 2), [("closing", at(9000), 0, 0, 0, "", "link", None)]], CLAIM)
    out, query = run_to_table(change_stream(stream, events, delay="90 s"), "attributed", f"{tmp_path}/out")
    got = rows(out.select(*COLUMNS))
    assert got == rows(want) and len(got) > 60 and len({r[6] for r in got}) == 6
    assert query.lastProgress["batchId"] >= 4
    plain, _ = run_to_table(change_stream(in_files(spark, f"{tmp_path}/again", [*shuffled(polls, 4, 3), end], POLL), delay="90 s"), "plain", f"{tmp_path}/plain")
    assert rows(plain.select(*COLUMNS[:5])) == rows(want.select(*COLUMNS[:5]))


def test_late_snapshots_are_counted(spark, tmp_path):
    polls = [[("h", at(0), 0, 0, {"k": "a"})], [("h", at(500), 5, 5, {"k": "b"})], [("h", at(510), 6, 6, {"k": "b"})],
             [("h", at(100), 1, 1, {"k": "c"}), ("h", at(490), 4, 4, {"k": "d"})], [("closing", at(9000), 0, 0, {})]]
    recorder = record_losses(spark, f"{tmp_path}/losses", every=2)
    try:
        out, query = run_to_table(change_stream(in_files(spark, f"{tmp_path}/in", polls, POLL), delay="60 s"), "late", f"{tmp_path}/out")
        recorder.wait_for(query)
    finally:
        spark.streams.removeListener(recorder)
    assert rows(out.select("snapshot", "old_value", "new_value")) == [(4, "a", "d"), (5, "d", "b")]
    sums = {r.name: r.raw for r in recorded_losses(spark, f"{tmp_path}/losses").groupBy("name").agg(F.sum("raw").alias("raw")).collect()}
    assert sums == {"stream/dropped_rows": 1, "stream/input_rows": 6}


def test_equal_changes_and_map_columns_are_kept(spark):
    changes = spark.createDataFrame([("h", 1, "mtu.eth0", {"a": 1}), ("h", 1, "mtu.eth0", {"a": 1}), ("h", 1, None, None), ("h", None, "mtu.eth0", None)],
                                    "hostname string, window_id bigint, key string, extra map<string,int>")
    events = spark.createDataFrame([("link", None, 1, 3, 77, "ip"), ("link", None, 1, 2, 78, "ifconfig")], "scope string, arg string, window_id bigint, seq bigint, pid bigint, comm string")
    got = sorted((r.key or "", r.window_id or 0, r.pid, r.comm) for r in attribute_changes(changes, events).collect())
    assert got == [("", 1, 0, "unknown"), ("mtu.eth0", 0, 0, "unknown"), ("mtu.eth0", 1, 78, "ifconfig"), ("mtu.eth0", 1, 78, "ifconfig")]


NUMBER = "i bigint"


def numbers(spark, path, files=5, each=20):
    return in_files(spark, path, [[(f * each + i,) for i in range(each)] for f in range(files)], NUMBER)


def test_a_sink_failing_twice_in_five_batches_loses_nothing(spark, tmp_path):
    letters, seen, heard, down = f"{tmp_path}/letters", {}, [], {1, 2}

    def sink(df, batch_id):
        if batch_id in down:
            down.discard(batch_id)
            raise ConnectionError(f"down at {batch_id}")
        seen[batch_id] = sorted(r.i for r in df.collect())

    export_stream(numbers(spark, f"{tmp_path}/in"), sink, checkpoint=f"{tmp_path}/cp", drain=True, dead_letters=letters,
                  on_failure=lambda b, e: heard.append((b, str(e)))).awaitTermination()
    assert heard == [(1, "down at 1"), (2, "down at 2")] and sorted(sum(seen.values(), [])) == list(range(100)) and len(seen) == 5
    ticks = rows(export_ticks(spark, letters).select("tick", "failures", "pending"))
    assert ticks == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 2, 0), (4, 2, 0)]
    counter = failure_counter(spark, letters, "table").orderBy("tick").collect()
    assert [r.raw for r in counter] == [0, 1, 2, 2, 2] and {r.name for r in counter} == {"exporter/sink/export_failures"} and counter[0].labels == {"sink": "table"}
    assert pending_batches(spark, letters) == []


def test_letters_outlive_the_query(spark, tmp_path):
    letters, seen = f"{tmp_path}/letters", []

    def refuse(df, batch_id):
        if batch_id >= 3:
            raise ConnectionError("down")
        seen.append(batch_id)

    export_stream(numbers(spark, f"{tmp_path}/in"), refuse, checkpoint=f"{tmp_path}/cp", drain=True, dead_letters=letters).awaitTermination()
    assert pending_batches(spark, letters) == [3, 4] and seen == [0, 1, 2]
    spark.createDataFrame([(1000,)], NUMBER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # a second query on the same checkpoint goes on counting, and replays nothing while the sink is down
    export_stream(spark.readStream.schema(NUMBER).parquet(f"{tmp_path}/in"), refuse, checkpoint=f"{tmp_path}/cp", drain=True, dead_letters=letters).awaitTermination()
    assert rows(export_ticks(spark, letters).where("tick > 2").select("tick", "failures", "pending")) == [(3, 1, 1), (4, 2, 2), (5, 3, 3)]
    taken = []
    assert replay_dead_letters(spark, letters, refuse) == [3, 4, 5]
    assert replay_dead_letters(spark, letters, lambda df, b: taken.append((b, df.count()))) == [] and taken == [(3, 20), (4, 20), (5, 1)]


def test_losses_beyond_the_reports_spark_holds(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(150).selectExpr("id", f"timestamp_micros({BASE} + id * 1000000) AS ts").repartitionByRange(150, "id").write.parquet(source)
    recorder = record_losses(spark, f"{tmp_path}/losses")
    try:
        stream = spark.readStream.schema("id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        _, query = run_to_table(stream, "long", f"{tmp_path}/out")
        recorder.wait_for(query)
    finally:
        spark.streams.removeListener(recorder)
    losses = recorded_losses(spark, f"{tmp_path}/losses")
    last = losses.where("name = 'stream/input_rows'").agg(F.max("total"), F.sum("raw"), F.count("*")).first()
    batches = query.lastProgress["batchId"] + 1
    assert batches >= 140 and tuple(last) == (150, 150, batches) and len(query.recentProgress) <= 100
