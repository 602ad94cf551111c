"""Captured text files to observations. Input: one row per line (host, ts, path, value).

Each parser is column expressions over single lines; only the header/data pairs
of one capture meet in a small aggregate.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetpulse.functions.text import encode_labels
from fleetpulse.schema import U64

U64_MAX = Decimal(2**64 - 1)
_U64 = r"^\+?\d{1,20}$"

# Fields of a CPU line and of an interface line.
CPU_FIELDS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
NET_FIELDS = {"receive/bytes": 0, "receive/errors": 2, "receive/dropped": 3,
              "transmit/bytes": 8, "transmit/errors": 10, "transmit/dropped": 11}
DISK_FIELDS = {"read/bytes": 2, "write/bytes": 6}
IGNORED_MEMORY_KEYS = ("VmallocTotal", "VmallocChunk")


def read_captures(spark: SparkSession, path: str, pattern: str = r"([^/]+)/(\d+)/[^/]*$") -> DataFrame:
    """Lines of captures stored as ``.../<host>/<epoch ms>/<file>``."""
    source = F.col("_metadata.file_path")
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.regexp_extract(source, pattern, 1).alias("host"),
                    F.timestamp_millis(F.regexp_extract(source, pattern, 2).try_cast("bigint")).alias("ts"),
                    source.alias("path"), "value"))


def _uint(c: Column) -> Column:
    """An unsigned 64-bit number; null for any other text."""
    number = F.when(c.rlike(_U64), c.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit(U64_MAX), number)


def _scaled(number: Column, factor: int) -> Column:
    """A product that stays within 64 bits; null where it would not."""
    wide = (number.cast("decimal(20,0)") * F.lit(Decimal(factor))).cast("decimal(38,0)")
    return F.when(wide <= F.lit(U64_MAX), wide)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.translate(c, "\t", " ")), r"\s+"), lambda w: w != "")


def _observation(df: DataFrame, name: Column, raw: Column, kind: str, unit, labels: Column | None = None) -> DataFrame:
    labels = F.create_map().cast("map<string,string>") if labels is None else labels
    unit = F.lit(unit) if isinstance(unit, str) else unit
    out = df.select("host", "ts", name.alias("name"), labels.alias("labels"), F.lit(kind).alias("kind"),
                    unit.alias("unit"), raw.cast(U64).alias("raw"))
    return out.where(F.col("raw").isNotNull()).withColumn("labels_key", encode_labels("labels"))


def ingest_exposition_text(lines: DataFrame) -> DataFrame:
    """Exposition samples: base metric, label keys, labels, value and optional timestamp.

    One ``_rate`` or ``_value`` suffix is removed once; ``percentile`` is no label key.
    """
    value = F.trim("value")
    sample = r'^([^{\s]+)(?:\{((?:[^"}]|"(?:\\.|[^"\\])*")*)\})?(?:\s+(\S+))?(?:\s+(\S+))?\s*$'
    pair = r'([^\s,={}"]+)\s*=\s*"((?:\\.|[^"\\])*)"'
    rows = lines.where((value != "") & ~F.startswith(value, F.lit("#")) & value.rlike(sample))
    full = F.regexp_extract(value, sample, 1)
    inner = F.regexp_extract(value, sample, 2)
    keys = F.regexp_extract_all(inner, F.lit(pair), F.lit(1))
    marker = "\u0001"

    def unescape(v):
        v = F.replace(v, F.lit("\\\\"), F.lit(marker))
        v = F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
        return F.replace(v, F.lit(marker), F.lit("\\"))

    values = F.transform(F.regexp_extract_all(inner, F.lit(pair), F.lit(2)), unescape)
    rows = rows.select("host", "ts", "path", full.alias("sample"), keys.alias("__k"), values.alias("__v"),
                       F.regexp_extract(value, sample, 3).try_cast("double").alias("value"),
                       F.regexp_extract(value, sample, 4).try_cast("bigint").alias("sample_ms"))
    entries = F.array_sort(F.arrays_zip(F.col("__k").alias("key"), F.col("__v").alias("value")))
    firsts = F.filter(entries, lambda e, i: (i == 0) | (F.element_at(entries, F.greatest(i, F.lit(1)))["key"] != e["key"]))
    label_keys = F.array_sort(F.array_distinct(F.filter("__k", lambda k: k != "percentile")))
    return rows.select(
        "host", "ts", "path", "sample", F.regexp_replace("sample", "(_rate|_value)$", "").alias("name"),
        label_keys.alias("label_keys"), F.map_from_entries(firsts).alias("labels"), "value", "sample_ms")


def exposition_tuples(parsed: DataFrame) -> DataFrame:
    return parsed.select("name", "label_keys").distinct()


def ingest_kv_text(lines: DataFrame) -> DataFrame:
    """``Key: N kB`` gauges named ``memory/<key>`` in bytes."""
    key = F.trim(F.split("value", ":")[0])
    rest = F.trim(F.try_element_at(F.split("value", ":"), F.lit(2)))
    number = _uint(F.split(rest, r"\s+")[0])
    raw = F.when(F.endswith(rest, F.lit("kB")), _scaled(number, 1024)).otherwise(number)
    rows = lines.where(F.col("value").contains(":") & ~key.isin(*IGNORED_MEMORY_KEYS))
    return _observation(rows, F.concat(F.lit("memory/"), F.lower(key)), raw, "gauge", "bytes")


def ingest_pair_text(lines: DataFrame) -> DataFrame:
    """``Key  N`` lines to (host, ts, path, proto, field, value); the protocol is the key's prefix."""
    words = _words(F.col("value"))
    rows = lines.select("host", "ts", "path", F.try_element_at(words, F.lit(1)).alias("field"),
                        _uint(F.try_element_at(words, F.lit(2))).alias("value"))
    return rows.where(F.col("value").isNotNull()).withColumn("proto", F.regexp_extract("field", "^([A-Za-z]+?6)", 1))


def ingest_header_pair_text(lines: DataFrame) -> DataFrame:
    """Header line plus data line per protocol to (host, ts, path, proto, field, value).

    Values that are not unsigned are dropped. The two lines of a protocol meet in
    an aggregate keyed by capture and protocol.
    """
    colon = F.col("value").contains(":")
    proto = F.trim(F.split("value", ":")[0])
    words = _words(F.try_element_at(F.split("value", ":", 2), F.lit(2)))
    is_data = F.coalesce(F.try_element_at(words, F.lit(1)).rlike(r"^[+-]?\d+$"), F.lit(False))
    rows = (lines.where(colon).select("host", "ts", "path", proto.alias("proto"), words.alias("__w"), is_data.alias("__d"))
            .groupBy("host", "ts", "path", "proto")
            .agg(F.max(F.when(~F.col("__d"), F.col("__w"))).alias("__names"), F.max(F.when(F.col("__d"), F.col("__w"))).alias("__values")))
    both = rows.where(F.col("__names").isNotNull() & F.col("__values").isNotNull())
    pairs = F.explode(F.arrays_zip(F.col("__names").alias("field"), F.col("__values").alias("value")))
    return (both.select("host", "ts", "path", "proto", pairs.alias("__p"))
            .select("host", "ts", "path", "proto", F.col("__p.field").alias("field"), _uint(F.col("__p.value")).alias("value"))
            .where(F.col("field").isNotNull() & F.col("value").isNotNull()))


def _numbers(words: Column) -> Column:
    # Words that are no unsigned numbers are skipped, later ones move up.
    return F.filter(F.transform(words, _uint), lambda n: n.isNotNull())


def ingest_cpu_text(lines: DataFrame) -> DataFrame:
    """Per-CPU lines: eight states, a missing last one counts 0; fewer than seven values are no CPU line."""
    words = _words(F.col("value"))
    numbers = _numbers(F.slice(words, F.lit(2), F.lit(8)))
    rows = (lines.where(F.startswith("value", F.lit("cpu")))
            .select("host", "ts", words[0].alias("cpu"), numbers.alias("__n")).where(F.size("__n") >= 7))
    states = F.array(*[F.struct(F.lit(s).alias("state"), F.coalesce(
        F.try_element_at("__n", F.lit(i + 1)), F.lit(0)).alias("raw")) for i, s in enumerate(CPU_FIELDS)])
    rows = rows.select("host", "ts", "cpu", F.explode(states).alias("__s"))
    return _observation(rows, F.concat(F.lit("cpu/usage/"), F.col("__s.state")), F.col("__s.raw"), "counter", "count",
                        F.create_map(F.lit("cpu"), F.col("cpu")))


def ingest_interface_text(lines: DataFrame) -> DataFrame:
    """One line per interface, at least twelve numbers."""
    iface = F.trim(F.split("value", ":")[0])
    numbers = _numbers(_words(F.try_element_at(F.split("value", ":", 2), F.lit(2))))
    rows = (lines.where(F.col("value").contains(":")).select("host", "ts", iface.alias("iface"), numbers.alias("__n"))
            .where((F.col("iface") != "") & ~F.col("iface").contains("|") & (F.size("__n") >= 12)))
    cells = F.array(*[F.struct(F.lit(f"network/{f}").alias("name"), F.element_at("__n", i + 1).alias("raw"))
                      for f, i in NET_FIELDS.items()])
    rows = rows.select("host", "ts", "iface", F.explode(cells).alias("__c"))
    unit = F.when(F.endswith("__c.name", F.lit("bytes")), F.lit("bytes")).otherwise(F.lit("count"))
    return _observation(rows, F.col("__c.name"), F.col("__c.raw"), "counter", unit,
                        F.create_map(F.lit("iface"), F.col("iface")))


def ingest_disk_text(lines: DataFrame) -> DataFrame:
    """One line per block device; sectors become bytes."""
    words = _words(F.col("value"))
    numbers = _numbers(F.slice(words, F.lit(4), F.greatest(F.size(words), F.lit(1))))
    rows = (lines.where(F.size(words) >= 10).select("host", "ts", words[2].alias("device"), numbers.alias("__n"))
            .where(F.size("__n") >= 7))
    cells = F.array(*[F.struct(F.lit(f"disk/{f}").alias("name"),
                               _scaled(F.element_at("__n", i + 1), 512).cast(U64).alias("raw"))
                      for f, i in DISK_FIELDS.items()])
    rows = rows.select("host", "ts", "device", F.explode(cells).alias("__c"))
    return _observation(rows, F.col("__c.name"), F.col("__c.raw"), "counter", "bytes",
                        F.create_map(F.lit("device"), F.col("device")))


def _by_file(lines: DataFrame, parsers: dict, table: str | None) -> DataFrame:
    """One parser, or all of them on the captures whose file name is theirs."""
    if table is not None:
        return parsers[table][1](lines)
    parts = [parse(lines.where(F.col("path").rlike(pattern))) for pattern, parse in parsers.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ingest_entity_table_text(lines: DataFrame, table: str | None = None) -> DataFrame:
    """``cpu``, ``interface`` or ``disk`` lines to long counters; without ``table`` the file name decides."""
    return _by_file(lines, {"cpu": (r"(^|[/_])stat$", ingest_cpu_text), "interface": (r"net[/_]dev$", ingest_interface_text),
                            "disk": (r"diskstats$", ingest_disk_text)}, table)


def _hundredths(c: Column) -> Column:
    return F.round(c.try_cast("double") * F.lit(100.0)).cast(U64)


def ingest_load_text(lines: DataFrame) -> DataFrame:
    """The three load averages in hundredths; a line without three numbers gives nothing."""
    words = _words(F.col("value"))
    loads = F.transform(F.slice(words, F.lit(1), F.lit(3)), _hundredths)
    rows = lines.where(F.size(words) >= 3).select("host", "ts", loads.alias("__l")).where(
        (F.size("__l") == 3) & F.forall("__l", lambda v: v.isNotNull()))
    cells = F.array(*[F.struct(F.lit(f"cpu/load/{n}").alias("name"), F.element_at("__l", i + 1).alias("raw"))
                      for i, n in enumerate(("load1", "load5", "load15"))])
    rows = rows.select("host", "ts", F.explode(cells).alias("__c"))
    return _observation(rows, F.col("__c.name"), F.col("__c.raw"), "gauge", "none")


def ingest_pressure_text(lines: DataFrame) -> DataFrame:
    """``some``/``full`` pressure averages in hundredths; the resource is the last part of the path's name."""
    kind = F.regexp_extract("value", "^(some|full)", 1)
    resource = F.regexp_extract("path", r"(cpu|memory|io)$", 1)
    rows = (lines.where(kind != "").select(
        "host", "ts", resource.alias("resource"), kind.alias("share"), F.explode(F.arrays_zip(
            F.regexp_extract_all("value", F.lit(r"(avg\d+)=(\S+)"), F.lit(1)).alias("avg"),
            F.regexp_extract_all("value", F.lit(r"(avg\d+)=(\S+)"), F.lit(2)).alias("v"))).alias("__p"))
        .where(F.col("__p.avg").isin("avg10", "avg60", "avg300")))
    raw = F.coalesce(_hundredths(F.col("__p.v")), F.lit(0).cast(U64))
    name = F.concat(F.lit("psi/"), "resource", F.lit("/"), "share", F.lit("_"), "__p.avg")
    return _observation(rows, name, raw, "gauge", "none")


def ingest_socket_text(lines: DataFrame) -> DataFrame:
    """Socket counts: inuse, tw and orphan for TCP, inuse for UDP; an absent count is 0."""
    words = _words(F.col("value"))
    fields = {"TCP:": ("inuse", "tw", "orphan"), "UDP:": ("inuse",)}
    rows = lines.select("host", "ts", words.alias("__w")).withColumn("__proto", F.try_element_at("__w", F.lit(1)))
    rows = rows.where(F.col("__proto").isin(*fields))
    cells = F.array(*[F.struct(F.lit(proto).alias("proto"), F.lit(field).alias("field"))
                      for proto, names in fields.items() for field in names])
    rows = (rows.select("*", F.explode(cells).alias("__c")).where(F.col("__c.proto") == F.col("__proto")))
    at = F.array_position("__w", F.col("__c.field"))
    raw = F.coalesce(_uint(F.try_element_at("__w", F.when(at > 0, at + 1).cast("int"))), F.lit(0).cast(U64))
    name = F.concat(F.lit("net/sockets/"), F.lower(F.translate("__c.proto", ":", "")), F.lit("_"), F.col("__c.field"))
    return _observation(rows, name, raw, "gauge", "count")


def ingest_pressure_load_text(lines: DataFrame, table: str | None = None) -> DataFrame:
    """``load``, ``pressure`` or ``socket`` captures to gauges; without ``table`` the file name decides."""
    return _by_file(lines, {"load": (r"loadavg$", ingest_load_text), "pressure": (r"pressure[/_](cpu|memory|io)$", ingest_pressure_text),
                            "socket": (r"sockstat6?$", ingest_socket_text)}, table)


def ingest_matrix_text(lines: DataFrame) -> DataFrame:
    """Per-CPU matrix lines summed to one total per type."""
    trimmed = F.trim(F.translate("value", "\t", " "))
    kind = F.trim(F.split(trimmed, ":")[0])
    numbers = _numbers(_words(F.try_element_at(F.split(trimmed, ":", 2), F.lit(2))))
    total = F.aggregate(numbers, F.lit(0).cast("decimal(38,0)"), lambda a, n: (a + n).cast("decimal(38,0)"))
    rows = (lines.where(~F.startswith(trimmed, F.lit("CPU")) & trimmed.contains(":"))
            .select("host", "ts", kind.alias("type"), total.alias("__t")).where(F.col("type") != ""))
    return _observation(rows, F.concat(F.lit("softirq/"), F.lower("type")), F.col("__t"), "counter", "count")
