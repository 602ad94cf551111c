import random

import pytest
from pyspark.sql import functions as F

from fleetpulse import (
    bucket_array, expire_stale, rollup_row, slice_histogram, sliding_histogram, subtract_buckets, windowed_distribution)
from fleetpulse.schema import SERIES

BASE = 1_704_067_200_000_000


def gauges(spark, rows):
    df = spark.createDataFrame([("m", "{}", BASE + us, v) for us, v in rows], "name string, labels_key string, us bigint, raw bigint")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_old_values_leave_the_window(spark):
    rows = [(0, 1_000_000)] * 100 + [(2_000_000 + i * 1000, 10) for i in range(100)]
    windows = sliding_histogram(slice_histogram(gauges(spark, rows)), "1 s", "1 s")
    last = rollup_row(bucket_array(windows)).orderBy(F.desc("window_slice")).first()
    assert last.p99 < 100


def test_bucket_array_is_ascending_and_complete(spark):
    slices = slice_histogram(gauges(spark, [(0, 10)] * 5 + [(1, 1000)] * 3))
    arrays = bucket_array(slices).first().buckets
    assert [b["bound"] for b in arrays] == sorted(b["bound"] for b in arrays)
    assert sum(b["count"] for b in arrays) == 8


@pytest.mark.parametrize("window,step", [("1 s", "100 ms"), ("1 s", "500 ms"), ("700 ms", "300 ms"), ("300 ms", "1 s")])
def test_sliding_windows_equal_direct_counts(spark, window, step):
    from fleetpulse.durations import micros
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 5_000_000), rnd.randint(0, 100)) for _ in range(300)]
    got = {(r.window_slice, r.bound): r["count"] for r in sliding_histogram(slice_histogram(gauges(spark, rows)), window, step).collect()}
    n, m = micros(window) // 100_000, micros(step) // 100_000
    want = {}
    for us, v in rows:
        k = (BASE + us) // 100_000
        for end in range(k, k + n):
            if (end + 1) % m == 0:
                want[(end, v)] = want.get((end, v), 0) + 1
    assert got == want


def test_merging_is_associative_and_order_free(spark):
    rnd = random.Random(2)
    df = gauges(spark, [(rnd.randint(0, 3_000_000), rnd.randint(0, 10**6)) for _ in range(500)])
    whole = slice_histogram(df, "1 s").groupBy("bound").agg(F.sum("count").alias("n"))
    parts = slice_histogram(df.where("us % 2 = 0"), "1 s").unionByName(slice_histogram(df.where("us % 2 = 1").repartition(7), "1 s"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.groupBy("bound").agg(F.sum("count")).collect()))


def test_cumulative_distribution_keeps_only_the_window(spark):
    rows = [("d", "{}", BASE, [(100, 10), (5000, 1000)])]
    rows += [("d", "{}", BASE + i * 10_000_000, [(100, 10 + 10 * i), (5000, 1000)]) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "name string, labels_key string, us bigint, buckets array<struct<bound:bigint,count:bigint>>").withColumn(
        "ts", F.timestamp_micros("us"))
    for thin in (False, True):
        for chunk in ("30 s", "1 h"):
            last = windowed_distribution(df, "60 s", thin=thin, chunk=chunk).orderBy(F.desc("ts")).first()
            counts = {b["bound"]: b["count"] for b in last.buckets}
            assert 5000 not in counts and 50 <= counts[100] <= 80
            assert last.raw == 1130
    first = windowed_distribution(df, "60 s").orderBy("ts").first()
    assert {b["bound"]: b["count"] for b in first.buckets} == {100: 10, 5000: 1000}, "full counts until a baseline exists"


def test_subtraction_saturates_and_drops_zeros(spark):
    t = "array<struct<bound:bigint,count:bigint>>"
    df = spark.createDataFrame([([(1, 5), (2, 7), (4, 1)], [(1, 5), (2, 9), (3, 8)])], f"n {t}, o {t}")
    assert [tuple(b) for b in df.select(subtract_buckets("n", "o").alias("b")).first().b] == [(4, 1)]


def test_stale_distribution_turns_empty(spark):
    t = "array<struct<bound:bigint,count:bigint>>"
    df = spark.createDataFrame([([(1, 5)],)], f"buckets {t}").withColumn("last_update", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    live = expire_stale(df, "2024-01-01 00:00:04", "5 s", "100 ms").first().buckets
    dead = expire_stale(df, "2024-01-01 00:00:16", "5 s", "100 ms").first().buckets
    edge = expire_stale(df, "2024-01-01 00:00:15", "5 s", "100 ms").first().buckets
    assert len(live) == 1 and dead == [] and len(edge) == 1


def test_clamped_values_are_counted(spark):
    out = slice_histogram(gauges(spark, [(0, 2**60), (1, 3)])).orderBy("bound").collect()
    assert [(r.bound, r.clamped) for r in out] == [(3, 0), (2**52 - 1, 1)]
    assert list(SERIES) == ["name", "labels_key"]
