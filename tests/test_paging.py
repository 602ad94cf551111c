"""Pages against slices of the sorted rows: ties, nulls, hot chunks, the last page, nothing at all."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetpulse import page
from fleetpulse.operators import paging

SCHEMA = "us bigint, labels_key string, raw decimal(20,0), id int, labels map<string,string>"


def data(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).drop("us")


def ordered(rows):
    """Nulls first, then by value, as Spark sorts."""
    return sorted(rows, key=lambda r: [(v is not None, v if v is not None else 0) for v in (r[0], r[1], r[2], r[3])])


def mixed(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, 5, 5, 5, 5, 7_000_000, 9_000_000]), rng.choice([None, "", "a", "b" * 40]), rng.choice([None, Decimal(2**64 - 1), Decimal(3)]),
             i, {"x": str(i)}) for i in range(n)]


@pytest.mark.parametrize("number,size", [(0, 10), (3, 17), (11, 50), (10**9, 64), (1, 400)])
def test_pages_are_slices(spark, number, size):
    rows = mixed(900, number + size)
    got = page(data(spark, rows), number, size, chunk="1 s", few=40).orderBy("row").collect()
    first = min(number, (len(rows) - 1) // size) * size
    assert [(r.row, r.id) for r in got] == [(first + i, r[3]) for i, r in enumerate(ordered(rows)[first:first + size])]
    assert all(r.labels == {"x": str(r.id)} for r in got)


def test_all_pages_together_are_all_rows(spark):
    df = data(spark, mixed(300, 5))
    ids = [r.id for n in range(6) for r in page(df, n, 50, chunk="1 s", few=20).collect()]
    assert sorted(ids) == list(range(300))


def test_equal_rows_fill_pages_once_each(spark):
    df = data(spark, [(5, "a", Decimal(1), 1, {})] * 500 + [(6, "a", Decimal(1), 2, {})] * 30)
    got = page(df, 9, 52, few=10).orderBy("row").collect()
    assert [r.row for r in got] == list(range(468, 520)) and [r.id for r in got] == [1] * 32 + [2] * 20


def test_a_hot_instant_is_not_sorted_whole(spark, monkeypatch):
    seen = []
    real = paging._narrowed

    def spy(rows, key, skip, size):
        out = real(rows, key, skip, size)
        seen.append(out[0].count())
        return out

    monkeypatch.setattr(paging, "_narrowed", spy)
    df = spark.range(200_000).select(F.timestamp_micros(F.lit(5)).alias("ts"), F.lit("k").alias("labels_key"), F.lit(1).alias("raw"), "id")
    got = page(df, 1234, 50, few=2000).orderBy("row").collect()
    assert [r.id for r in got] == list(range(61_700, 61_750))
    assert seen[-1] <= 2000 and len(seen) <= 5


def test_no_rows_give_no_page(spark):
    out = page(data(spark, []), 3)
    assert out.columns[-1] == "row" and out.count() == 0


def test_numbers_as_order_and_bounds_reach_the_scan(spark, tmp_path):
    spark.range(1000).withColumn("raw", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    out = page(spark.read.parquet(str(tmp_path / "t")), 4, 25, order=("id",), chunk=100)
    assert [r.id for r in out.orderBy("row").collect()] == list(range(100, 125))
    assert "GreaterThanOrEqual(id,100)" in out._jdf.queryExecution().toString()
