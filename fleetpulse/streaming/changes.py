"""Configuration changes as a stream, named by a second stream of events.

Both streams meet in one state machine per host. Rows wait until the watermark, the
lower of the two streams', has passed them and are then applied in event-time order: an
event joins the events of its drain window, a snapshot is compared with the one before
it and takes the events of its window along. Who did it is decided outside the machine,
by the same claims as in batch.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetpulse.durations import interval_text, micros
from fleetpulse.operators.joins import _claims, normal_arg
from fleetpulse.streaming.processors import InOrder

FIRST_TIE = -(2**63)
_CHANGES = "array<struct<key:string,old_value:string,new_value:string>>"
_EVENTS = "array<struct<seq:bigint,pid:bigint,comm:string,scope:string,arg:string>>"


class ConfigTimeline(InOrder):
    """Changes between a host's adjacent snapshots, with the events of the newer one's window.

    Of a window's events the first of each (scope, arg) is held, until a snapshot of a later
    window has passed.
    """

    waits = "us bigint, tie bigint, window bigint, config string, claim string"
    keeps = "us bigint, snapshot bigint, config string, events string"

    def advance(self, state, rows):
        snapshot, config, held = None, None, {}
        if state is not None:
            snapshot, config = state[1], None if state[2] is None else json.loads(state[2])
            held = {(w, scope, arg): (seq, pid, comm) for w, scope, arg, seq, pid, comm in json.loads(state[3])}
        out = []
        for r in rows.to_dict("records"):
            window = int(r["window"])
            if r["claim"]:
                claim = json.loads(r["claim"])
                at, who = (window, claim["scope"], claim["arg"]), (claim["seq"], claim.get("pid"), claim.get("comm"))
                if at not in held or who[0] < held[at][0]:
                    held[at] = who
                continue
            if snapshot is not None and int(r["tie"]) <= snapshot:
                continue  # the same snapshot again
            fresh = json.loads(r["config"])
            changes = [] if config is None else [
                {"key": k, "old_value": config[k], "new_value": v} for k, v in fresh.items()
                if v is not None and config.get(k) is not None and config[k] != v]
            if changes:
                events = [{"seq": seq, "pid": pid, "comm": comm, "scope": scope, "arg": arg}
                          for (w, scope, arg), (seq, pid, comm) in held.items() if w == window]
                out.append((int(r["tie"]), window, changes, events))
            snapshot, config = int(r["tie"]), fresh
            held = {at: who for at, who in held.items() if at[0] >= window}
        kept = json.dumps([[*at, *who] for at, who in held.items()])
        state = (int(rows["us"].iloc[-1]), snapshot, None if config is None else json.dumps(config), kept)
        return state, pd.DataFrame(out, columns=["snapshot", "window", "changes", "events"])


def claimed_by(key: str, events: str) -> Column:
    """The event ``struct(priority, seq, pid, comm)`` that claims a key with the best (priority, seq), else null."""
    def hits(claim):
        own = F.filter(F.col(events), lambda e: (e["scope"] == claim["scope"]) & (e["arg"] == claim["arg"]))
        return F.transform(own, lambda e: F.struct(claim["priority"].alias("priority"), e["seq"].alias("seq"), e["pid"].alias("pid"), e["comm"].alias("comm")))

    return F.array_min(F.flatten(F.transform(_claims(F.col(key)), hits)))


def timeline_stream(snapshots: DataFrame, events: DataFrame | None = None, keys: Sequence[str] = ("hostname",), window: str | None = None,
                    delay="60 s", drain="0 s") -> DataFrame:
    """Changes of streamed snapshots (keys, ts, snapshot, config map), in event-time order whatever order they come in.

    With a stream of ``events`` (keys, ts, ``window``, seq, pid, comm, scope, arg) each change has pid and comm: of the events of its
    window up to ``drain`` after the snapshot, the one that claims its key; 0 and 'unknown' if none does. ``window`` (LONG,
    default the snapshot number) rises with time. Rows later than ``delay`` are dropped and counted by Spark.
    """
    keys = list(keys)
    column = F.col(window or "snapshot").cast("bigint").alias("window")
    drain_us = micros(drain)
    polls = snapshots.where("ts is not null").withWatermark("ts", interval_text(delay)).select(
        *keys, "ts", (F.unix_micros("ts") + F.lit(drain_us)).alias("us"), F.col("snapshot").cast("bigint").alias("tie"),
        column, F.to_json("config").alias("config"), F.lit("").alias("claim")).where("config is not null and window is not null")
    rows = polls
    if events is not None:
        named = events.withColumn("arg", normal_arg()).where(
            "ts is not null and seq is not null and scope is not null and (scope != 'sysctl' or arg != '')")
        claims = named.withWatermark("ts", interval_text(delay)).select(
            *keys, "ts", F.unix_micros("ts").alias("us"), F.lit(FIRST_TIE).cast("bigint").alias("tie"), column, F.lit("").alias("config"),
            F.to_json(F.struct("seq", "pid", "comm", "scope", "arg")).alias("claim"))
        rows = polls.unionByName(claims.where("window is not null"))
    long = T.LongType()
    arrays = T.StructType.fromDDL(f"changes {_CHANGES}, events {_EVENTS}")
    out = T.StructType([rows.schema[k] for k in keys] + [T.StructField("snapshot", long), T.StructField("window", long), *arrays.fields])
    found = rows.groupBy(*keys).transformWithStateInPandas(ConfigTimeline(keys), out, "append", "eventTime")
    each = found.select(*keys, "snapshot", "window", "events", F.explode("changes").alias("__c")).select(
        *keys, "snapshot", "window", "events", "__c.key", "__c.old_value", "__c.new_value")
    if events is None:
        return each.drop("events", "window")
    who = each.withColumn("__who", claimed_by("key", "events"))
    return who.select(*keys, "snapshot", "key", "old_value", "new_value",
                      F.coalesce("__who.pid", F.lit(0)).cast("bigint").alias("pid"), F.coalesce("__who.comm", F.lit("unknown")).alias("comm"))
