"""Configuration snapshots: flatten, diff, attribute, annotate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetpulse.operators.chunks import with_previous
from fleetpulse.operators.joins import attribute_changes

# Key name -> field of the sysctl struct.
SYSCTL_KEYS = {
    "tcp_rmem_max": "tcp_rmem",
    "tcp_wmem_max": "tcp_wmem",
    "rmem_max": "rmem_max",
    "wmem_max": "wmem_max",
    "netdev_max_backlog": "netdev_max_backlog",
    "tcp_slow_start_after_idle": "tcp_slow_start_after_idle",
    "tcp_congestion_control": "tcp_congestion_control",
}

# Key pattern -> field of an interface struct.
INTERFACE_KEYS = {
    "ring.{}.rx": "ring_rx",
    "ring.{}.tx": "ring_tx",
    "ring.{}.rx_max": "ring_rx_max",
    "mtu.{}": "mtu",
    "channels.{}.rx": "rx_queues",
    "channels.{}.tx": "tx_queues",
    "channels.{}.combined": "combined_queues",
    "rss.{}.table_size": "rss_table_size",
    "msix.{}.vectors": "msix_vectors",
    "coalesce.{}.rx_usecs": "coalesce_rx_usecs",
    "coalesce.{}.tx_usecs": "coalesce_tx_usecs",
    "sysctl.conf.{}.rp_filter": "rp_filter",
}

# Key pattern -> per-queue list of the steering struct.
STEERING_KEYS = {
    "rps.{}.rx-": "rps",
    "xps.{}.tx-": "xps",
    "irq.{}.": "irq_affinity",
}

ARROW = " → "


def flatten_config(df: DataFrame) -> DataFrame:
    """Nested configuration rows to (ts, hostname, key, value); one narrow pass, no shuffle.

    A snapshot becomes its parts (the host's own settings, then each interface), a part its keys, and a
    per-queue list its queues: three plain generators of flat columns, all in generated code.
    """
    item = "array<struct<id:bigint,value:string>>"
    part = "struct<key:string,value:" + df.schema["interfaces"].dataType.valueType.simpleString() + ">"

    def one(key, value):
        value = value.cast("string")
        held = F.when(value.isNotNull(), F.array(F.struct(F.lit(None).cast("bigint").alias("id"), value.alias("value"))))
        return F.struct(key.alias("stem"), F.lit(False).alias("listed"), held.cast(item).alias("items"))

    name, info = F.col("__part.key"), F.col("__part.value")

    def named(pattern):
        before, after = pattern.split("{}")
        return F.concat(F.lit(before), name, F.lit(after))

    sysctl = F.array(*[
        one(F.lit(f"sysctl.{key}"),
            F.try_element_at(F.col(f"sysctl.{field}"), F.lit(3)) if field in ("tcp_rmem", "tcp_wmem") else F.col(f"sysctl.{field}"))
        for key, field in SYSCTL_KEYS.items()])
    interface = F.array(*[one(named(p), info[field]) for p, field in INTERFACE_KEYS.items()], *[
        F.struct(named(p).alias("stem"), F.lit(True).alias("listed"), info["steering"][field].cast(item).alias("items")) for p, field in STEERING_KEYS.items()])
    # The part without a name is the host's own; map keys are never null.
    parts = F.concat(F.array(F.lit(None).cast(part)), F.coalesce(F.map_entries("interfaces"), F.array().cast(f"array<{part}>")))
    return (df.select(F.timestamp_millis("timestamp_ms").alias("ts"), "hostname", "sysctl", F.explode(parts).alias("__part"))
            .select("ts", "hostname", F.explode(F.when(name.isNull(), sysctl).otherwise(interface)).alias("__group"))
            .select("ts", "hostname", F.col("__group.stem").alias("__stem"), F.col("__group.listed").alias("__listed"),
                    F.explode("__group.items").alias("__item"))
            .where(F.col("__item.value").isNotNull())
            .select("ts", "hostname", F.when(F.col("__listed"), F.concat("__stem", F.col("__item.id").cast("string")))
                    .otherwise(F.col("__stem")).alias("key"), F.col("__item.value").alias("value")))


def snapshots_a_chunk(df: DataFrame, snapshot: str):
    """A width of chunks for a column of snapshots: a day of times, 4096 of whole numbers; none for other types."""
    kind = df.schema[snapshot].dataType
    return "1 day" if isinstance(kind, T.TimestampType) else 4096 if isinstance(kind, T.IntegralType) else None


def config_diff(df: DataFrame, host: str = "hostname", snapshot: str = "snapshot", chunk="by type") -> DataFrame:
    """Keys present in two adjacent snapshots of a host with different values.

    A key's snapshots are compared in chunks of ``chunk`` (a time, or a number; None: all at once), by default of
    ``snapshots_a_chunk``: no key's history is one task.

    New and vanished keys emit nothing: the key's previous row must belong to
    the host's directly preceding snapshot.
    """
    chunk = snapshots_a_chunk(df, snapshot) if chunk == "by type" else chunk
    taken = df.select(host, snapshot).distinct()
    taken = with_previous(taken, [host], [snapshot], {"__before": snapshot}, chunk)
    rows = with_previous(df, [host, "key"], [snapshot], {"__prev": snapshot, "old_value": "value"}, chunk)
    changed = rows.where(F.col("__prev").isNotNull() & (F.col("old_value") != F.col("value")))
    # Only candidates meet the snapshot list.
    return (changed.join(taken, [host, snapshot]).where(F.col("__prev") == F.col("__before"))
            .withColumnRenamed("value", "new_value").drop("__prev", "__before"))


def config_values(df: DataFrame) -> DataFrame:
    """Only the values that are numbers, for plotting."""
    number = F.trim("value")
    return (df.where(number == F.col("value")).withColumn("value", number.try_cast("double"))
            .where(F.col("value").isNotNull()))


def _amount(value: Column) -> Column:
    count = F.when(value.rlike(r"^\+?\d{1,20}$"), value.try_cast("decimal(20,0)"))
    whole = F.format_string("%.0f", F.bround(count / F.lit(1_000_000), 0).cast("double"))
    return F.when(count.isNotNull(), F.concat(value, F.lit(" ("), whole, F.lit("MB)"))).otherwise(value)


def change_note(key, old, new) -> Column:
    """Human-readable text of one change."""
    key, old, new = (F.col(c) if isinstance(c, str) else c for c in (key, old, new))
    parts = F.split(key, r"\.", 3)
    kind, second, third = parts[0], F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    plain = F.concat(old, F.lit(ARROW), new)
    on_iface = F.concat(F.lit("  ("), second, F.lit(")"))
    field = F.concat(kind, F.lit("."), third, F.lit(": "), plain, on_iface)
    three = F.size(parts) == 3
    return (F.when((kind == "sysctl") & second.contains("mem"),
                   F.concat(key, F.lit(": "), _amount(old), F.lit(ARROW), _amount(new)))
            .when(three & kind.isin("ring", "coalesce", "channels"), field)
            .when((kind == "mtu") & (F.size(parts) == 2), F.concat(F.lit("MTU: "), plain, on_iface))
            .when(three & (kind == "rss") & (third == "table_size"), field)
            .when(three & (kind == "msix") & (third == "vectors"), field)
            .otherwise(F.concat(key, F.lit(": "), plain)))


def attributed_note(key="key", old="old_value", new="new_value", pid="pid", comm="comm") -> Column:
    return F.concat(F.col(key), F.lit(": "), F.col(old), F.lit(ARROW), F.col(new), F.lit("  (pid="),
                    F.col(pid).cast("string"), F.lit(", comm="), F.col(comm), F.lit(")"))


def _triple(value: Column) -> Column:
    words = F.split(F.trim(value), r"\s+")
    named = F.transform(words, lambda w, i: F.concat(
        F.element_at(F.array(F.lit("min="), F.lit("default="), F.lit("max=")), i + 1),
        F.floor(w.try_cast("bigint") / F.lit(1024)).cast("string"), F.lit("K")))
    return F.when((F.size(words) == 3) & F.forall(words, lambda w: w.rlike(r"^\d+$")),
                  F.array_join(named, " / ")).otherwise(value)


def change_tags(key, old, new) -> Column:
    """Annotation ``struct(text, tags)`` of a change whose key is written ``class:part:part``."""
    key, old, new = (F.col(c) if isinstance(c, str) else c for c in (key, old, new))
    parts = F.split(key, ":", 3)
    kind, second, third = parts[0], F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    base = F.lit("sysconfig")
    sysctl_tags = F.array_compact(F.array(base, F.lit("sysctl"), F.when(
        second.contains("rmem") | second.contains("wmem"), F.lit("tcp-buffers")).when(
        second.contains("congestion"), F.lit("congestion-control"))))
    plain = F.concat(old, F.lit(ARROW), new)
    fields = kind.isin("ring", "channels", "coalesce")
    text = (F.when(kind == "sysctl", F.concat(second, F.lit(":  "), _triple(old), F.lit("  →  "), _triple(new)))
            .when(fields, F.concat(kind, F.lit("."), third, F.lit(": "), plain, F.lit("  ("), second, F.lit(")")))
            .when(kind == "mtu", F.concat(F.lit("MTU: "), plain, F.lit("  ("), second, F.lit(")")))
            .otherwise(F.concat(key, F.lit(": "), plain)))
    tags = (F.when(kind == "sysctl", sysctl_tags)
            .when(fields | (kind == "mtu"), F.array(base, kind, second))
            .otherwise(F.array(base)))
    return F.struct(text.alias("text"), tags.alias("tags"))


def change_rows(df: DataFrame, attributed: bool = False) -> DataFrame:
    """Changes as rows of the change table, with their note; times stay those of the observation."""
    note = attributed_note() if attributed else change_note("key", "old_value", "new_value")
    return df.select("ts", "hostname", "key", "old_value", "new_value", note.alias("note"))


def latest_config_snapshot(df: DataFrame, keys: Sequence[str] = ("hostname", "ts"), version: str = "version",
                           value: str = "snapshot") -> DataFrame:
    """The newest version per key, as a map-side combined aggregate."""
    return df.groupBy(*keys).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))


def change_timeline(snapshots: DataFrame, events: DataFrame, window: Sequence[str] = ("window_id",),
                    chunk="by type") -> DataFrame:
    """Snapshots and events to attributed, annotated changes.

    ``snapshots``: hostname, snapshot, ts, ``window``, key, value.
    """
    changes = config_diff(snapshots, chunk=chunk)
    return (attribute_changes(changes, events, window)
            .withColumn("note", attributed_note()))
