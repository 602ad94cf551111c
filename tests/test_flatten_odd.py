"""Configuration snapshots with parts missing, and a plan without interpreted lambdas."""

from pyspark.sql import functions as F

from fleetpulse import flatten_config
from fleetpulse.schema import CONFIG_STATE


def state(spark, interfaces, sysctl=None, host="h"):
    row = {"timestamp_ms": 5, "hostname": host, "sysctl": sysctl, "interfaces": interfaces}
    return spark.createDataFrame([tuple(row.get(f.name) for f in CONFIG_STATE)], CONFIG_STATE)


def keys(df):
    return {(r.key, r.value) for r in flatten_config(df).collect()}


def info(**given):
    kind = CONFIG_STATE["interfaces"].dataType.valueType
    return tuple(given.get(f.name) for f in kind)


def test_missing_parts_give_no_rows(spark):
    assert keys(state(spark, None)) == set() and keys(state(spark, {})) == set()
    assert keys(state(spark, {"p1": None})) == set()
    assert keys(state(spark, {"p1": info(mtu=1500), "p2": info()})) == {("mtu.p1", "1500")}
    assert flatten_config(state(spark, {"p1": info(mtu=1500)}).limit(0)).count() == 0


def test_queue_lists(spark):
    steering = ([(3, "f"), (4, None), (None, "1")], None, [])
    got = keys(state(spark, {"a.b": info(steering=steering)}))
    assert got == {("rps.a.b.rx-3", "f"), (None, "1")}


def test_no_shuffle_and_no_lambda(spark):
    plan = flatten_config(state(spark, {"p1": info(mtu=9000)}).union(state(spark, None))).select(F.upper("key"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lambda" not in plan
