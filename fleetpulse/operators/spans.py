"""Event pairs and completions: time in state, latencies, counts by reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fleetpulse.functions.h2 import KERNEL_GROUPING, h2_bound
from fleetpulse.operators.chunks import CHUNK, DEFAULT_CHUNK, SEED, chunk_of, with_previous, without_seeds

# Reasons that count as a receive-path drop.
DROP_REASONS = (
    "CPU_BACKLOG",
    "SOCKET_RCVBUFF",
    "PROTO_MEM",
    "NO_SOCKET",
    "SOCKET_BACKLOG",
    "NETFILTER_DROP",
    "TC_INGRESS",
    "UNHANDLED_PROTO",
)


def state_durations(df: DataFrame, entity: Sequence[str] = ("cpu",), span: str = "span", action: str = "action",
                    state: str = "state", order: Sequence[str] = ("ts",), chunk=DEFAULT_CHUNK) -> DataFrame:
    """Enter/leave events to one row per completed stay, in microseconds.

    Each ``span`` kind pairs on its own, so interrupt spans nest inside others.
    A stay belongs to the state named on entry; a second entry restarts it, a
    leave without an entry is ignored, a negative stay counts as 0.
    """
    keys = [*entity, span]
    at = F.unix_micros("ts")
    rows = with_previous(df.withColumn("__us", at), keys, order,
                         {"__action": action, "__state": state, "__since": "__us"}, chunk)
    closed = rows.where((F.col(action) == "leave") & (F.col("__action") == "enter"))
    return closed.select(*keys, F.col("__state").alias(state), F.timestamp_micros("__since").alias("entered"),
                         "ts", F.greatest(F.col("__us") - F.col("__since"), F.lit(0)).alias("us"))


def time_in_state(durations: DataFrame, entity: Sequence[str] = ("cpu",), state: str = "state") -> DataFrame:
    return durations.groupBy(*entity, "span", state).agg(
        F.sum("us").alias("us"), F.count(F.lit(1)).alias("stays"))


def paired_latency(df: DataFrame, keys: Sequence[str] = ("sock",), action: str = "action",
                   order: Sequence[str] = ("ts",), chunk=DEFAULT_CHUNK) -> DataFrame:
    """Latency from the first pending ``start`` to the next ``end``, per key.

    ``end`` and ``destroy`` clear the pending start. Rows: keys, ts, us, bound.

    A chunk needs only the start still pending when it opens. That is the first
    start after the last clearing event before it; every chunk contributes its
    first start after its own last clear.
    """
    keys, order = list(keys), list(order)
    body = df.select(*keys, *order, action).withColumn("__us", F.unix_micros("ts"))
    clears = F.col(action).isin("end", "destroy")
    starts = F.col(action) == "start"
    body = body.withColumn(CHUNK, chunk_of(df, order[0], chunk)).withColumn(SEED, F.lit(False))

    last_clear = body.where(clears).groupBy(*keys, CHUNK).agg(F.max(F.struct(*order)).alias("__clear"))
    tails = (body.where(starts).join(last_clear, [*keys, CHUNK], "left")
             .groupBy(*keys, CHUNK)
             .agg(F.min(F.when(F.col("__clear").isNull() | (F.struct(*order) > F.col("__clear")), F.col("__us"))).alias("__tail")))
    chunks = body.select(*keys, CHUNK).distinct().join(tails, [*keys, CHUNK], "left").join(
        last_clear.select(*keys, CHUNK, F.lit(True).alias("__cleared")), [*keys, CHUNK], "left")
    per_key = Window.partitionBy(*keys).orderBy(CHUNK)
    # Chunks since the last clearing one form an epoch; its earliest tail start is pending.
    epoch = F.sum(F.coalesce(F.col("__cleared").cast("int"), F.lit(0))).over(
        per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pending = F.min("__tail").over(Window.partitionBy(*keys, "__epoch").orderBy(CHUNK)
                                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = chunks.withColumn("__epoch", epoch).withColumn("__pending", pending)
    seeds = (carried.select(*keys, CHUNK, F.lag("__pending").over(per_key).alias("__us"))
             .where(F.col("__us").isNotNull())
             .withColumns({SEED: F.lit(True), action: F.lit("start")}))
    both = body.unionByName(seeds, allowMissingColumns=True)

    ordered = Window.partitionBy(*keys, CHUNK).orderBy(F.desc(SEED), *order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    segment = F.coalesce(F.sum(clears.cast("int")).over(before), F.lit(0))
    rows = both.withColumn("__segment", segment)
    start = F.min(F.when(starts, F.col("__us"))).over(Window.partitionBy(*keys, CHUNK, "__segment"))
    ends = without_seeds(rows.withColumn("__start", start)).where(
        (F.col(action) == "end") & F.col("__start").isNotNull() & (F.col("__start") <= F.col("__us")))
    us = F.col("__us") - F.col("__start")
    return ends.select(*keys, "ts", us.alias("us"), h2_bound(us, KERNEL_GROUPING, 52).alias("bound"))


def latency_histogram(latencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return latencies.groupBy(*by, "bound").agg(F.count(F.lit(1)).alias("count"))


def completion_stats(df: DataFrame, device: str = "device", op: str = "op") -> DataFrame:
    """Bytes of every completion; requests and latency only of the one finishing a request."""
    final = F.col("nr_bytes") >= F.col("remaining")
    return (df.where(F.col(op).isin("read", "write")).groupBy(device, op)
            .agg(F.sum("nr_bytes").alias("bytes"), F.count_if(final).alias("requests"),
                 F.sum(F.when(final, F.greatest(F.col("latency_ns"), F.lit(0))).otherwise(F.lit(0))).alias("latency_ns")))


def completion_latency(df: DataFrame, device: str = "device", op: str = "op") -> DataFrame:
    """Latency histogram of finished requests."""
    return (df.where(F.col(op).isin("read", "write") & (F.col("nr_bytes") >= F.col("remaining")))
            .groupBy(device, op, h2_bound(F.greatest(F.col("latency_ns"), F.lit(0)), KERNEL_GROUPING, 52).alias("bound"))
            .agg(F.count(F.lit(1)).alias("count")))


def drop_reasons(df: DataFrame, iface: str = "iface", by_reason: bool = False) -> DataFrame:
    """Receive drops by listed reason and failed transmits, per interface."""
    received = F.col("direction").eqNullSafe("rx") & F.col("reason").isin(*DROP_REASONS)
    sent = F.col("direction").eqNullSafe("tx") & (F.col("rc") != 0)
    keys = [iface, "reason"] if by_reason else [iface]
    return (df.where(received | sent).groupBy(*keys)
            .agg(F.count_if(received).alias("rx_dropped"), F.count_if(sent).alias("tx_dropped")))
