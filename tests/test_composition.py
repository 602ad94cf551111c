"""Chunk functions composed as a tree: series whose chains never meet, small fanouts, many series."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import composition, spacing

BASE = 1_704_067_200_000_000


def kept(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def test_levels():
    day = 86_400_000_000
    assert [composition.tree_levels(w) for w in (100_000, 600_000_000, day, 10_000 * day)] == [4, 2, 2, 1]
    assert composition.tree_levels(100_000, 8) > 10


@pytest.mark.parametrize("fanout", [64, 4096])
def test_chains_that_never_meet(spark, monkeypatch, fanout):
    """Readings at an exact period: the chain through each phase stays apart from the others for good."""
    monkeypatch.setattr(composition.compose, "__defaults__", (fanout,))
    rnd, rows, want = random.Random(fanout), [], {}
    for k, (period, gap_every) in {"a": (300_000, None), "b": (300_000, 700), "c": (70_000, 333), "old": (250_000, None)}.items():
        t, times = (BASE if k != "old" else -100_000_000), []
        for i in range(1500):
            t += period if gap_every is None or i % gap_every else 40_000_000 + rnd.randint(0, 5) * 10_000
            times.append(t)
        want[k] = kept(times, 1_000_000)
        rows += [(k, t) for t in times]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, us bigint").withColumn("ts", F.timestamp_micros("us")).repartition(5)
    out = spacing.kept_chain(df, ["k"], "ts", 1.0, chunk="2 s")
    got = out.select("k", "us", "prev_us").collect()
    for k, times in want.items():
        mine = sorted((r.us, r.prev_us) for r in got if r.k == k)
        assert mine == list(zip(times, [None, *times[:-1]]))


def test_no_group_by_series_alone(spark):
    df = spark.createDataFrame([("a", BASE)], "k string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    plan = spacing.kept_chain(df, ["k"], "ts", 1.0)._jdf.queryExecution().executedPlan().toString()
    groups = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line or "FlatMapGroupsInBatch" in line]
    assert len(groups) >= 5 and not any("[k#" in line.split("],")[0] and "," not in line.split("[", 1)[1].split("]")[0] for line in groups)
