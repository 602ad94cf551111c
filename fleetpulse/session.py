"""Session settings this library expects; a cluster's own settings win."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC timestamps always, a state store on disk where none is set.

    Functions of this package travel to the workers by value, so these need no copy of it.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    store = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(store, "HDFSBackedStateStoreProvider"):
        spark.conf.set(store, ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``, or that was given
    to ``setCheckpointDir``; only where both are unset and Spark is local, as in tests, on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    unique = f"{name}-{uuid.uuid4().hex}"
    if base:
        return f"{base.rstrip('/')}/{unique}"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix='fleetpulse-')}/{unique}"


def local_session(cores: str | int = "*", name: str = "fleetpulse", **extra) -> SparkSession:
    """A session for tests and single-node runs."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
               .config("spark.driver.memory", "8g"))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
