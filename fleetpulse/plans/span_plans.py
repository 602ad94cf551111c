"""Queries for event pairs and completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import spans as T
from fleetpulse.plans.adapters import ACTION_OF_EVENT, CENTS, bound_sql, cents, events, pair_events, table
from fleetpulse.plans.registry import plan


def state_events(spark, sf):
    """Enter and leave events per core; two span kinds, the state named on entry."""
    n = F.col("event_id") % 3
    return events(spark, sf).select(
        (F.col("user_id") % 8).alias("cpu"), "ts", "event_id",
        F.when(F.col("user_id") % 2 == 0, "idle").otherwise("irq").alias("span"),
        F.when(n == 0, "leave").otherwise("enter").alias("action"),
        F.when(n == 1, "iowait").otherwise("idle").alias("state"))


_STATES = """st AS (SELECT user_id % 8 AS cpu, epoch_us(ts) AS us, event_id, CASE WHEN user_id % 2 = 0 THEN 'idle' ELSE 'irq' END AS span,
    CASE WHEN event_id % 3 = 0 THEN 'leave' ELSE 'enter' END AS action, CASE WHEN event_id % 3 = 1 THEN 'iowait' ELSE 'idle' END AS state FROM events),
sl AS (SELECT *, lag(action) OVER w AS pa, lag(state) OVER w AS ps, lag(us) OVER w AS pu FROM st WINDOW w AS (PARTITION BY cpu, span ORDER BY us, event_id)),
du AS (SELECT cpu, span, ps AS state, pu AS entered_us, us AS left_us, greatest(us - pu, 0) AS us FROM sl WHERE action = 'leave' AND pa = 'enter')"""


@plan("state_durations", f"WITH {_STATES} SELECT cpu, span, state, entered_us, left_us, us FROM du")
def state_durations(spark, sf):
    out = T.state_durations(state_events(spark, sf), order=["ts", "event_id"], chunk="2 days")
    return out.select("cpu", "span", "state", F.unix_micros("entered").alias("entered_us"), F.unix_micros("ts").alias("left_us"), "us")


@plan("time_in_state", f"WITH {_STATES} SELECT cpu, span, state, CAST(sum(us) AS BIGINT) AS us, count(*) AS stays FROM du GROUP BY ALL")
def time_in_state(spark, sf):
    return T.time_in_state(T.state_durations(state_events(spark, sf), order=["ts", "event_id"], chunk="2 days"))


_ACTION = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, a in ACTION_OF_EVENT.items()) + " END"
_PAIRS = f"""pe AS (SELECT user_id, epoch_us(ts) AS us, event_id, {_ACTION} AS action FROM events),
sg AS (SELECT *, coalesce(sum(CASE WHEN action IN ('end', 'destroy') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM pe),
fs AS (SELECT *, min(CASE WHEN action = 'start' THEN us END) OVER (PARTITION BY user_id, seg) AS start_us FROM sg),
lat AS (SELECT user_id, us AS end_us, us - start_us AS us FROM fs WHERE action = 'end' AND start_us <= us)"""


@plan("paired_latency", f"WITH {_PAIRS} SELECT user_id, end_us, us, {bound_sql('us', 3)} AS bound FROM lat")
def paired_latency(spark, sf):
    out = T.paired_latency(pair_events(spark, sf), ["user_id"], order=["ts", "event_id"], chunk="2 days")
    return out.select("user_id", F.unix_micros("ts").alias("end_us"), "us", "bound")


@plan("latency_histogram", f"WITH {_PAIRS} SELECT {bound_sql('us', 3)} AS bound, count(*) AS n FROM lat GROUP BY ALL")
def latency_histogram(spark, sf):
    out = T.paired_latency(pair_events(spark, sf), ["user_id"], order=["ts", "event_id"], chunk="2 days")
    return T.latency_histogram(out).withColumnRenamed("count", "n")


def completions(spark, sf):
    li = table(spark, sf, "lineitem")
    op = F.when(F.col("l_linenumber") % 4 == 0, "flush").when(F.col("l_linenumber") % 2 == 0, "write").otherwise("read")
    return li.select(F.concat(F.lit("sd"), (F.col("l_suppkey") % 10).cast("string")).alias("device"), op.alias("op"),
                     F.col("l_quantity").cast("bigint").alias("nr_bytes"), (F.col("l_orderkey") % 60).alias("remaining"),
                     (F.col("l_partkey") * 977 - 5000).alias("latency_ns"))


_COMPLETIONS = """co AS (SELECT 'sd' || (l_suppkey % 10) AS device, CASE WHEN l_linenumber % 4 = 0 THEN 'flush' WHEN l_linenumber % 2 = 0 THEN 'write' ELSE 'read' END AS op,
    CAST(l_quantity AS BIGINT) AS nr_bytes, l_orderkey % 60 AS remaining, greatest(l_partkey * 977 - 5000, 0) AS latency_ns FROM lineitem)"""


@plan("completion_stats", f"""WITH {_COMPLETIONS} SELECT device, op, CAST(sum(nr_bytes) AS BIGINT) AS bytes, count(CASE WHEN nr_bytes >= remaining THEN 1 END) AS requests,
CAST(sum(CASE WHEN nr_bytes >= remaining THEN latency_ns ELSE 0 END) AS BIGINT) AS latency_ns FROM co WHERE op <> 'flush' GROUP BY ALL""")
def completion_stats(spark, sf):
    return T.completion_stats(completions(spark, sf))


@plan("completion_latency", f"""WITH {_COMPLETIONS} SELECT device, op, {bound_sql('latency_ns', 3)} AS bound, count(*) AS n FROM co WHERE op <> 'flush' AND nr_bytes >= remaining GROUP BY ALL""")
def completion_latency(spark, sf):
    return T.completion_latency(completions(spark, sf)).withColumnRenamed("count", "n")


_REASONS = ("CPU_BACKLOG", "TCP_RESET", "NO_SOCKET", "NOT_SPECIFIED", "UNHANDLED_PROTO")


@plan("drop_reasons", f"""WITH d AS (SELECT 'if' || user_id % 6 AS iface, CASE WHEN event_id % 2 = 0 THEN 'rx' ELSE 'tx' END AS direction,
    CASE user_id % 5 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS))} END AS reason, {CENTS} % 3 AS rc FROM events),
f AS (SELECT *, direction = 'rx' AND reason IN ('CPU_BACKLOG', 'NO_SOCKET', 'UNHANDLED_PROTO') AS r, direction = 'tx' AND rc <> 0 AS t FROM d)
SELECT iface, count(CASE WHEN r THEN 1 END) AS rx_dropped, count(CASE WHEN t THEN 1 END) AS tx_dropped FROM f WHERE r OR t GROUP BY iface""")
def drop_reasons(spark, sf):
    reason = F.element_at(F.array(*[F.lit(r) for r in _REASONS]), (F.col("user_id") % 5 + 1).cast("int"))
    rows = events(spark, sf).select(F.concat(F.lit("if"), (F.col("user_id") % 6).cast("string")).alias("iface"),
                                    F.when(F.col("event_id") % 2 == 0, "rx").otherwise("tx").alias("direction"), reason.alias("reason"), (cents() % 3).alias("rc"))
    return T.drop_reasons(rows)
