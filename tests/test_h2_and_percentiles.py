import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from fleetpulse import (
    bucket_array, dense_to_sparse, event_total, h2_bound, h2_bound_of_index, h2_bucket_total, h2_clamp, h2_index, percentile_columns,
    percentiles_from_buckets, percentiles_or_null, rollup_row)
from fleetpulse.plans.catalog import PLANS

BUCKETS = "array<struct<bound:bigint,count:bigint>>"


def bound_of(v, g, n):
    v = min(v, 2**n - 1)
    if v < 2 ** (g + 1):
        return v
    s = v.bit_length() - 1 - g
    return (((v >> s) + 1) << s) - 1


def index_of(v, g, n):
    v = min(v, 2**n - 1)
    if v < 2 ** (g + 1):
        return v
    p = v.bit_length() - 1
    return (p - g + 1) * 2**g + ((v - 2**p) >> (p - g))


EDGES = [0, 1, 7, 8, 15, 16, 17, 100, 1000, 2**64 - 1] + [x for p in range(3, 64) for x in (2**p - 1, 2**p, 2**p + 1)]


def test_bounds_and_indexes_at_every_power_of_two(spark):
    df = spark.createDataFrame([(Decimal(v),) for v in EDGES], "v decimal(20,0)")
    for g, n in ((3, 64), (7, 52)):
        rows = df.select("v", h2_bound("v", g, n).alias("b"), h2_index("v", g, n).alias("i"),
                         h2_bound_of_index(h2_index("v", g, n), g, n).alias("back")).collect()
        for r in rows:
            v = int(r.v)
            assert int(r.b) == bound_of(v, g, n) == int(r.back), (v, g)
            assert r.i == index_of(v, g, n), (v, g)
    assert h2_bucket_total(3, 64) == 496 and h2_bucket_total(7, 52) == 5888
    top = df.where(F.col("v") == Decimal(2**64 - 1)).select(h2_index("v", 3, 64).alias("i")).first().i
    assert top == 495


def test_small_values_are_exact(spark):
    rows = spark.range(8).select("id", h2_bound("id", 3, 64).alias("b")).collect()
    assert all(int(r.b) == r.id for r in rows)


def test_negative_values_and_nulls_keep_their_place(spark):
    df = spark.createDataFrame([(-1,), (-5,), (-2**63,), (None,)], "v bigint")
    rows = df.select("v", h2_bound("v", 3, 52).alias("b"), h2_index("v", 3, 52).alias("i")).collect()
    assert [(r.b, r.i) for r in rows] == [(-1, -1), (-1, -5), (-1, -2**63), (2**52 - 1, 399)]


def test_the_value_is_named_a_few_times(spark):
    for c in (h2_bound("the_value", 3, 64), h2_index("the_value", 3, 64), h2_bound("the_value"), h2_index("the_value")):
        assert repr(c).count("the_value") <= 10


def test_large_values_pin_the_top_bucket(spark):
    df = spark.createDataFrame([(Decimal(2**64 - 1),), (Decimal(5),)], "v decimal(20,0)")
    rows = sorted(r.c for r in df.select(h2_clamp("v").alias("c")).collect())
    assert rows == [5, 2**52 - 1]


def test_products_beyond_64_bits_are_clamped(spark, tmp_path):
    rows = [(3, 4, "A"), (0, 1, "A"), (3_294_062, 7, "N"), (9_000_000, 7, "N"), (2**63 - 1, 7, "R"), (None, 1, "R"), (1, 1, "R")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_returnflag: (r.n, r.clamped, r.top) for r in PLANS["h2_clamped"](spark, str(tmp_path)).collect()}
    assert got == {"A": (2, 0, 12 * 4 * 10**11), "N": (2, 2, 2**52 - 1), "R": (3, 1, 2**52 - 1)}


def _pct(spark, buckets, ps, fn=percentiles_from_buckets):
    df = spark.createDataFrame([(buckets,)], f"b {BUCKETS}")
    return [None if v is None else int(v) for v in df.select(fn("b", ps).alias("p")).first().p]


def test_nearest_rank_examples(spark):
    assert _pct(spark, [(10, 90), (1000, 10)], (50, 90, 99)) == [10, 10, 1000]
    assert _pct(spark, [], (50, 99)) == [0, 0]
    assert _pct(spark, [(100, 90), (1000, 10)], (50, 99), percentiles_or_null) == [100, 1000]
    assert _pct(spark, [], (50, 99), percentiles_or_null) == [None, None]


def test_rollup_row_example(spark):
    df = spark.createDataFrame([([(10, 600), (15, 300), (30, 98), (31, 2)],)], f"buckets {BUCKETS}")
    r = rollup_row(df).first()
    assert (r.p50, r.p90, r.p99, r.p999) == (10, 15, 30, 31)


def test_percentiles_match_sorted_values_within_a_bucket_and_are_monotone(spark):
    rnd = random.Random(7)
    groups = {g: [rnd.randint(0, 10 ** rnd.randint(1, 12)) for _ in range(rnd.randint(1, 400))] for g in range(40)}
    ps = (1, 50, 90, 99, 99.9, 100)
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v bigint")
    counts = df.groupBy("g", h2_bound("v").alias("bound")).agg(F.count(F.lit(1)).alias("count"))
    arrays = {r.g: [int(x) for x in r.p] for r in
              bucket_array(counts).select("g", percentiles_from_buckets("buckets", ps).alias("p")).collect()}
    names = [f"q{i}" for i in range(len(ps))]
    rows = {r.g: [r[n] for n in names] for r in percentile_columns(counts, ["g"], ps, names).collect()}
    for g, values in groups.items():
        values.sort()
        want = [bound_of(values[min(max(math.ceil(p / 100 * len(values)), 1), len(values)) - 1], 7, 52) for p in ps]
        assert arrays[g] == want == rows[g]
        assert arrays[g] == sorted(arrays[g])


def test_dense_counts_become_sparse(spark):
    counts = [0] * 496
    counts[3], counts[17], counts[495] = 2, 5, 1
    df = spark.createDataFrame([(counts,), ([1, 0, 4],)], "counts array<bigint>")
    long, short = [[(int(b["bound"]), b["count"]) for b in r.buckets] for r in dense_to_sparse(df).collect()]
    assert long == [(3, 2), (19, 5), (2**64 - 1, 1)]
    assert short == [(0, 1), (2, 4)]


def test_event_total(spark):
    df = spark.createDataFrame([([(100, 10), (5000, 1000)],), ([],)], f"b {BUCKETS}")
    assert [int(r.t) for r in df.select(event_total("b").alias("t")).collect()] == [1010, 0]
