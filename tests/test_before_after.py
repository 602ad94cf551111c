"""Means around changes against a plain loop, and the plan that gives them."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetpulse import before_after

OBS = "host string, name string, us bigint, value double"


def plain(obs, changes, before, after):
    out = {}
    for host, change, at in changes:
        sides = defaultdict(lambda: ([], []))
        for h, name, us, value in obs:
            if h is None or h != host or us is None or at is None or not at - before <= us <= at + after:
                continue
            sides[name][us >= at].append(value)
        for name, pair in sides.items():
            known = [[v for v in side if v is not None] for side in pair]
            means = [math.fsum(k) / len(k) if k else None for k in known]
            out[(host, change, name)] = (*means, len(pair[0]), len(pair[1]))
    return out


def frames(spark, obs, changes):
    rows = spark.createDataFrame(obs, OBS).withColumn("ts", F.timestamp_micros("us")).drop("us")
    marks = spark.createDataFrame(changes, "host string, change bigint, at bigint").withColumn("change_ts", F.timestamp_micros("at")).drop("at")
    return rows, marks


def found(df):
    return {(r.host, r.change, r.name): (r.before, r.after, r.n_before, r.n_after) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key][2:] == row[2:], key
        for x, y in zip(got[key][:2], row[:2], strict=True):
            assert x is None and y is None or x == pytest.approx(y, rel=1e-12), key


@pytest.mark.parametrize("before,after", [(100, 100), (3, 1), (0, 7), (40, 0), (1, 500), (37, 1000)])
def test_equals_the_pairs(spark, before, after):
    rng = random.Random(before * 1009 + after)
    obs = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None]), rng.choice([None, *range(2000)]),
            rng.choice([None, 0.0, -1.5, 2.25, 1e6])) for _ in range(600)]
    obs += obs[:40]
    changes = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, *range(-50, 2050)])) for i in range(80)]
    rows, marks = frames(spark, obs, changes)
    got = before_after(rows, marks, before / 1e6, after / 1e6, keys=["host"], change_id=["change"], by=["name"], panes=4)
    same(found(got), plain(obs, changes, before, after))


def test_borders_and_ties(spark):
    obs = [("a", "x", us, float(v)) for us, v in ((10, 1), (20, 2), (20, 4), (30, 8), (31, 16), (9, 32))]
    rows, marks = frames(spark, obs, [("a", 1, 20), ("a", 2, 20)])
    got = found(before_after(rows, marks, 10 / 1e6, 10 / 1e6, keys=["host"], change_id=["change"], by=["name"]))
    assert got == {("a", c, "x"): (1.0, (2 + 4 + 8) / 3, 1, 3) for c in (1, 2)}


def test_one_bad_value_stays_in_its_own_spans(spark):
    obs = [("a", "x", us, math.nan if us == 50 else float(us)) for us in range(0, 400, 10)]
    rows, marks = frames(spark, obs, [("a", 1, 60), ("a", 2, 300)])
    got = found(before_after(rows, marks, 20 / 1e6, 20 / 1e6, keys=["host"], change_id=["change"], by=["name"]))
    assert math.isnan(got[("a", 1, "x")][0]) and got[("a", 1, "x")][1] == 70.0
    assert got[("a", 2, "x")] == (285.0, 310.0, 2, 3)


def test_changes_at_one_instant_do_not_multiply_rows(spark):
    """2000 changes over 2000 rows of one pane: four million pairs if they were paired."""
    rows = spark.range(2000).select(F.timestamp_micros("id").alias("ts"), F.col("id").cast("double").alias("value"))
    marks = spark.range(2000).select(F.col("id").alias("change"), F.timestamp_micros(F.lit(1000)).alias("change_ts"))
    got = before_after(rows, marks, 1, 1, change_id=["change"], panes=1)
    assert got.agg(F.count("*"), F.min("before"), F.max("before"), F.min("n_after"), F.max("after")).first()[:] == (2000, 499.5, 499.5, 1000, 1499.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides_and_decimals(spark):
    rows = spark.createDataFrame([("a", "x", 5, 1.0)], OBS).withColumn("ts", F.timestamp_micros("us")).drop("us")
    none = spark.createDataFrame([], "host string, change_ts timestamp")
    assert before_after(rows, none, keys=["host"]).count() == 0
    one = spark.createDataFrame([("a", 5)], "host string, at bigint").select("host", F.timestamp_micros("at").alias("change_ts"))
    assert before_after(rows.limit(0), one, keys=["host"]).count() == 0
    exact = rows.withColumn("value", F.lit("18446744073709551615").cast("decimal(20,0)"))
    r = before_after(exact, one, keys=["host"]).first()
    assert (r.before, int(r.after), r.n_before, r.n_after) == (None, 2**64 - 1, 0, 1)
