import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetpulse import (
    counter_rate, entity_delta, irate, layout_guard, multiplex_scale, paired_latency, port_retransmits, queue_cv, queue_delta, queue_delta_guarded, raw_rate,
    running_total, spaced_rows, state_durations, with_previous)
from fleetpulse.operators.chunks import asof_join

BASE = 1_704_067_200_000_000


def readings(spark, rows):
    """(ms, value) readings of one series."""
    df = spark.createDataFrame([("m", "{}", BASE + int(ms * 1000), i, Decimal(v)) for i, (ms, v) in enumerate(rows)],
                               "name string, labels_key string, us bigint, i bigint, raw decimal(20,0)")
    return df.withColumn("ts", F.timestamp_micros("us"))


def rates(df, **kw):
    return [int(r.rate) for r in counter_rate(df, tie="i", **kw).orderBy("ts").collect()]


def test_steady_counter(spark):
    got = rates(readings(spark, [(10 * i, 1000 * i) for i in range(51)]))
    assert len(got) == 50 and all(95_000 <= r <= 105_000 for r in got)


def test_jittered_tick_coalesces(spark):
    assert rates(readings(spark, [(0, 0), (1, 25_000_000), (10, 25_000_000)])) == [2_500_000_000]


def test_fast_ticks_average(spark):
    got = sorted(rates(readings(spark, [(2 * i, 1000 * i) for i in range(401)])))
    assert 450_000 <= got[len(got) // 2] <= 550_000


def test_reset_has_no_rate(spark):
    got = rates(readings(spark, [(10, 1000), (20, 2000), (30, 5)]))
    assert got == [100_000]


def test_full_unsigned_range(spark):
    got = rates(readings(spark, [(0, 0), (1000, 2**64 - 1), (2000, 3)]))
    assert len(got) == 1 and abs(got[0] - (2**64 - 1)) <= 2**12


def brute(rows, gap):
    prev, out = None, []
    for t, _, v in sorted(rows):
        if prev is None or v < prev[1]:
            prev = (t, v)
        elif t - prev[0] >= gap:
            out.append((t, v, int((v - prev[1]) / ((t - prev[0]) / 1e6) + 0.5)))
            prev = (t, v)
    return out


@pytest.mark.parametrize("density", [3, 400])
def test_counter_rate_equals_brute_force_for_every_chunk_width(spark, density):
    rnd, rows, want = random.Random(density), [], []
    for s in range(4):
        t, v, series = BASE, 0, []
        for i in range(500):
            t += int(rnd.expovariate(density / 1_000_000)) * (1 if rnd.random() < 0.97 else 200)
            v = v + rnd.randint(0, 1000) if rnd.random() < 0.97 else rnd.randint(0, v + 1)
            series.append((t, i, v))
        rows += [("m", str(s), t, i, v) for t, i, v in series]
        want += [(str(s), *r) for r in brute(series, 50_000)]
    df = spark.createDataFrame(rows, "name string, labels_key string, us bigint, i bigint, raw bigint").withColumn(
        "ts", F.timestamp_micros("us"))
    for chunk, parts in (("100 ms", 3), ("1 s", 7), ("1 h", 1)):
        got = counter_rate(df.repartition(parts), 0.05, tie="i", chunk=chunk).select(
            "labels_key", F.unix_micros("ts"), F.col("raw").cast("long"), F.col("rate").cast("long")).collect()
        assert sorted(map(tuple, got)) == sorted(want), chunk


def test_spaced_rows(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.timestamp_micros(F.lit(BASE) + F.col("id") * 300_000).alias("ts"))
    kept = spaced_rows(df, ["k"], "ts", 1.0, chunk="3 s").select(F.unix_micros("ts")).collect()
    assert sorted(r[0] - BASE for r in kept) == list(range(0, 29_700_001, 1_200_000))


def test_raw_rate_rules(spark):
    df = readings(spark, [(0, 100), (1000, 300), (1000, 500), (2000, 100), (3000, 100)])
    got = [r.rate for r in raw_rate(df, tie=["i"]).orderBy("ts", "i").collect()]
    assert got == [None, 200.0, None, None, 0.0]
    cut = raw_rate(df, tie=["i"], start=F.timestamp_micros(F.lit(BASE + 1_000_000))).orderBy("ts", "i").collect()
    assert cut[0].rate == 200.0, "the first row in range may use the row before it"


def test_retransmits_per_port(spark):
    rows = [(1, 80, 54000, 1, 5), (1, 80, 54001, 2, 0), (2, 80, 54000, 1, 8), (2, 80, 54001, 2, 1), (2, 40000, 45000, 3, 9), (2, 22, 9100, 0, 7)]
    df = spark.createDataFrame(rows, "tick bigint, sport int, dport int, inode bigint, total_retrans bigint")
    assert [(r.port, r.tick, r.total) for r in port_retransmits(df).collect()] == [(80, 2, 4)]


def test_a_known_port_is_reported_at_every_tick(spark):
    rows = [("h", 1, 80, 1, 5), ("h", 2, 80, 1, 8), ("h", 3, 443, 2, 1), ("h", 5, 80, 1, 9), ("h", 6, 80, 1, 11), ("h", 7, 443, 2, 1), ("g", 9, 80, 1, 1)]
    df = spark.createDataFrame(rows, "host string, tick bigint, sport int, inode bigint, total_retrans bigint").withColumn("dport", F.lit(50000))
    for chunk in (None, 2, 100):
        got = sorted((r.host, r.port, r.tick, r.total) for r in port_retransmits(df, chunk=chunk, by=["host"]).collect())
        assert got == [("h", 80, 2, 3), ("h", 80, 3, 3), ("h", 80, 5, 3), ("h", 80, 6, 5), ("h", 80, 7, 5)]
        one = sorted((r.port, r.tick, r.total) for r in port_retransmits(df.where("host = 'h'"), chunk=chunk).collect())
        assert one == [row[1:] for row in got]


def test_queue_baselines_end_with_their_layout(spark):
    rows = [(t, "eth0", q, 10 * t) for t in range(1, 7) for q in range(2 if t < 3 else 3)]
    df = spark.createDataFrame(rows, "ts bigint, iface string, queue int, value bigint")
    for chunk in (None, 2, 100):
        got = sorted((r.ts, r.queue, r.delta) for r in queue_delta_guarded(df, chunk=chunk).collect())
        assert got == [(t, q, 10) for t in (5, 6) for q in range(3)]


def test_entity_delta_forgets_a_missing_entity(spark):
    rows = [(1, "a", 1, 5), (2, "a", 1, 9), (4, "a", 1, 20), (5, "a", 2, 30), (6, "a", 2, 29), (7, "a", 2, 31)]
    df = spark.createDataFrame(rows, "tick bigint, e string, g int, v bigint")
    for chunk in (None, 2, 100):
        got = [r.delta for r in entity_delta(df, ["e"], "tick", "v", "g", chunk).orderBy("tick").collect()]
        assert got == [0, 4, 0, 0, 0, 2]


def test_starved_queue_raises_the_spread(spark):
    rows = [(t, "eth0", q, v) for t, vs in ((1, (100, 100, 100, 100)), (2, (200, 200, 200, 100))) for q, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "ts bigint, iface string, queue int, value bigint")
    deltas = queue_delta(df, chunk=1)
    assert sorted(r.delta for r in deltas.collect()) == [0, 100, 100, 100]
    r = queue_cv(deltas).first()
    assert r.cv > 0.5 and r.rss_cv == int(r.cv * 100)


def test_spread_is_withheld_when_meaningless(spark):
    rows = [(1, "a", d) for d in (0, 0, 1, 0)] + [(2, "a", 500)] + [(3, "a", 100)] * 4
    df = spark.createDataFrame(rows, "ts int, iface string, delta bigint")
    got = {r.ts: r.cv for r in queue_cv(df).collect()}
    assert got[1] is None and got[2] is None and got[3] < 0.01


def test_multiplexed_counts(spark):
    rows = [(1, [50], 100, 50), (2, [150], 200, 150), (3, [150], 300, 150), (4, [200], 400, 200)]
    df = spark.createDataFrame([("s", 0, "g", t, [Decimal(c) for c in cs], e, r) for t, cs, e, r in rows],
                               "source string, cpu int, group string, t bigint, counts array<decimal(20,0)>, enabled bigint, running bigint")
    df = df.withColumn("ts", F.timestamp_micros(F.lit(BASE) + F.col("t") * 1_000_000))
    got = multiplex_scale(df, chunk="2 s").orderBy("ts").collect()
    assert [int(r.total) for r in got] == [100, 200, 200, 300]
    assert [r.coverage for r in got][:3] == [50, 100, 0]


def test_layout_change_skips_the_snapshot(spark):
    rows = [(t, "eth0", f"s{i}", i) for t, n in ((1, 3), (2, 3), (3, 5), (4, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "ts bigint, iface string, stat_name string, value bigint")
    assert sorted({r.ts for r in layout_guard(df, chunk=2).collect()}) == [2, 4]


def test_irate_takes_the_last_two_points(spark):
    df = readings(spark, [(0, 0), (10_000, 50), (20_000, 150), (30_000, 30)])
    at = irate(df, "5m", at="2024-01-01 00:00:25", tie=["i"]).first()
    assert at.rate == 10.0
    after_reset = irate(df, "5m", at="2024-01-01 00:01:00", tie=["i"]).first()
    assert after_reset.rate == 3.0


@pytest.mark.parametrize("chunk", [None, "2 s", "7 s", "1 h"])
def test_chunked_windows_equal_plain_ones(spark, chunk):
    rnd = random.Random(5)
    rows = [(k, BASE + rnd.randint(0, 60) * 1_000_000 + i, rnd.randint(0, 9)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, us bigint, v bigint").withColumn("ts", F.timestamp_micros("us"))
    out = running_total(with_previous(with_previous(df, ["k"], ["ts"], {"p": "v"}, chunk), ["k"], ["ts"], {"n": "v"}, chunk, ahead=True),
                        ["k"], ["ts"], "v", "s", chunk)
    got = {(r.k, r.us): (r.p, r.n, r.s) for r in out.collect()}
    for k in "ab":
        series = sorted((us, v) for key, us, v in rows if key == k)
        total = 0
        for i, (us, v) in enumerate(series):
            total += v
            want = (series[i - 1][1] if i else None, series[i + 1][1] if i + 1 < len(series) else None, total)
            assert got[(k, us)] == want


@pytest.mark.parametrize("chunk", ["3 s", "1 h"])
def test_asof_join(spark, chunk):
    rnd = random.Random(3)
    left = [("k", BASE + rnd.randint(0, 90_000_000), i) for i in range(200)]
    right = sorted({BASE + rnd.randint(0, 90_000_000) for _ in range(15)})
    dl = spark.createDataFrame(left, "k string, us bigint, i int").withColumn("ts", F.timestamp_micros("us"))
    dr = spark.createDataFrame([("k", us, n) for n, us in enumerate(right)], "k string, u bigint, n int").withColumn("at", F.timestamp_micros("u"))
    got = {r.i: r.n for r in asof_join(dl, dr, ["k"], "ts", "at", ["n"], chunk, shift="5 s").collect()}
    for _, us, i in left:
        older = [n for n, u in enumerate(right) if u <= us - 5_000_000]
        assert got[i] == (older[-1] if older else None)


@pytest.mark.parametrize("chunk", ["2 s", "1 h"])
def test_pairs_and_stays_equal_a_state_machine(spark, chunk):
    rnd = random.Random(11)
    rows = [(k, BASE + i * 400_000 + rnd.randint(0, 300_000), rnd.choice(["start", "start", "end", "destroy", "other"])) for k in "xyz" for i in range(150)]
    df = spark.createDataFrame(rows, "sock string, us bigint, action string").withColumn("ts", F.timestamp_micros("us"))
    want = []
    for k in "xyz":
        pending = None
        for _, us, action in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if action == "start":
                pending = us if pending is None else pending
            elif action in ("end", "destroy"):
                if action == "end" and pending is not None:
                    want.append((k, us, us - pending))
                pending = None
    got = paired_latency(df, chunk=chunk).select("sock", F.unix_micros("ts"), "us").collect()
    assert sorted(map(tuple, got)) == sorted(want)

    stays = df.select("sock", "ts", F.lit("idle").alias("span"), F.when(F.col("action") == "start", "enter").otherwise("leave").alias("action"),
                      F.when(F.unix_micros("ts") % 2 == 0, "idle").otherwise("iowait").alias("state"))
    want = []
    for k in "xyz":
        since = None
        for _, us, action in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if action == "start":
                since = us
            else:
                if since is not None:
                    want.append((k, "idle" if since % 2 == 0 else "iowait", us - since))
                since = None
    got = state_durations(stays, ["sock"], chunk=chunk).select("sock", "state", "us").collect()
    assert sorted(map(tuple, got)) == sorted(want)
