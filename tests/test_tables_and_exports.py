import json
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetpulse import (
    apply_retention, decode_buckets, decode_labels, encode_buckets, encode_labels, export_csv, export_json, exposition_text, latest_config_snapshot,
    load_session, raw_rate, read_captures, read_recording, recording_catalog, validate_recording, write_recording, write_samples)
from fleetpulse.schema import RECORDING

SNAPSHOT = "ts timestamp, name string, labels map<string,string>, kind string, unit string, raw bigint, buckets array<struct<bound:bigint,count:bigint>>"


def snapshot(spark, *rows):
    df = spark.createDataFrame([(n, lab, k, u, raw, b) for n, lab, k, u, raw, b in rows], SNAPSHOT.replace("ts timestamp, ", ""))
    return df.withColumn("ts", F.lit("2024-01-01 00:00:01").cast("timestamp"))


SENT = ("fabric/sent-octets", {"lane": "q7"}, "counter", "bytes", 73110, [(2303, 41), (8191, 3)])


def test_exposition_families(spark):
    rows = [SENT, ("fabric/sent-octets", {"lane": "q8"}, *SENT[2:]), ("tcp/rtt_us", {"source": "ebpf"}, "distribution", "count", 7, [(5, 7)]),
            ("tcp/rtt_us", {"port": "443"}, "gauge", "count", 9, [(9, 1)]), ("x", {"a": 'q"\\\n'}, "gauge", "none", 1, [])]
    text = [r.value for r in exposition_text(snapshot(spark, *rows), (50, 99)).collect()]
    assert 'fabric_sent_octets{lane="q7"} 73110' in text and 'fabric_sent_octets_rate{lane="q7",percentile="99"} 8191' in text
    types = [t for t in text if t.startswith("# TYPE")]
    assert len(types) == len(set(types)) and text.count("# TYPE fabric_sent_octets counter") == 1
    assert {"# TYPE tcp_rtt_us gauge", "# TYPE tcp_rtt_us_count counter", "# TYPE tcp_rtt_us_rate gauge", "# TYPE tcp_rtt_us_value gauge"} <= set(types)
    assert 'x{a="q\\"\\\\\\n"} 1' in text and 'x_value{a="q\\"\\\\\\n",percentile="50"} 0' in text
    families = [t.split()[2] for t in types]
    assert families == sorted(families)
    assert text.index("# TYPE fabric_sent_octets counter") + 1 == text.index('fabric_sent_octets{lane="q7"} 73110')


def test_json_lines(spark):
    got = json.loads(export_json(snapshot(spark, ('rack "9"', {"lane": 'up\tdown "x" \\ \r'}, *SENT[2:])), (50, 99.9)).first().value)
    assert got == {"name": 'rack "9"', "labels": {"lane": 'up\tdown "x" \\ \r'}, "raw": 73110, "percentiles": {"50": 2303, "99.9": 8191}}


def demo(spark):
    """120 ticks of three interface counters and a gauge, with a burst in the middle."""
    ticks = spark.range(120)
    base = 1_750_000_000_000
    step = F.when(F.col("id").between(45, 59), 3).otherwise(1)
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("iface")) for n, i in (
        ("network/receive/bytes", "eth0"), ("network/receive/bytes", "eth1"), ("network/receive/bytes", "eth2"), ("memory/free", ""))]))
    rows = ticks.select((F.lit(base) + F.col("id") * 1000).alias("ts_unix_ms"), names.alias("n"), (F.col("id") * 1000 * step).alias("raw"))
    return rows.select("ts_unix_ms", "n.name", F.when(F.col("n.iface") == "", "{}").otherwise(F.concat(F.lit('{"iface":"'), "n.iface", F.lit('"}'))).alias("labels_json"),
                       F.when(F.col("n.iface") == "", "gauge").otherwise("counter").alias("kind"), F.lit("bytes").alias("unit"),
                       F.col("raw").cast("decimal(20,0)").alias("raw"), F.lit("[[10,5],[30,2]]").alias("buckets_json"))


def test_recording_round_trip_catalog_and_session(spark, tmp_path):
    for name in ("a", "b"):
        demo(spark).write.parquet(str(tmp_path / name))
    (tmp_path / "a" / "unfinished.tmp").write_text("not parquet")
    rows = read_recording(spark, str(tmp_path / "a"))
    assert rows.count() == 480
    assert rows.where(F.col("labels")["iface"] == "eth0").count() == 120
    first = rows.agg(F.min("ts").alias("t")).first().t
    eth0 = rows.where(F.col("labels")["iface"] == "eth0")
    ranged = raw_rate(eth0, start=F.lit(first) + F.expr("interval 10 seconds"), end=F.lit(first) + F.expr("interval 16 seconds"))
    assert ranged.count() == 7 and ranged.where("rate is null").count() == 0
    r = rows.first()
    assert (int(r.p50), int(r.p99)) == (10, 30) and [tuple(map(int, b)) for b in r.buckets] == [(10, 5), (30, 2)]
    session = load_session(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ordered=True)
    assert session.count() == 480
    files = recording_catalog(spark, str(tmp_path)).collect()
    assert sum(f.rows for f in files) == 960 and all(f.file.endswith(".parquet") for f in files)
    assert [f.file for f in files] == sorted((f.file for f in files), reverse=True)

    export_csv(eth0, str(tmp_path / "csv"))
    texts = [p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("*.csv"))]
    lines = [line for t in texts for line in t.split("\r\n") if line]
    header = '"ts_unix_ms","time_utc","name","labels_json","kind","unit","raw","p50","p90","p99","p999"'
    assert sum(line != header for line in lines) == 120 and header in lines
    assert '"{""iface"":""eth0""}"' in lines[1] and '"2025-06-15 15:0' in lines[1]
    gap = eth0.limit(1).withColumns({"p99": F.lit(None).cast("bigint"), "name": F.lit('=1+"x"')})
    export_csv(gap, str(tmp_path / "gap"))
    cells = [p.read_text() for p in (tmp_path / "gap").glob("*.csv") if p.stat().st_size][0].splitlines()[1]
    assert cells.endswith('"10","30","","30"') and "\"'=1+" in cells


def test_invalid_rows_are_quarantined(spark):
    ok = (1000, "m", '{"a":"2"}', "gauge", "count", Decimal(1), "[[10,5],[30,2]]")

    def changed(**kw):
        return tuple(kw.get(n, v) for n, v in zip(RECORDING.fieldNames(), ok, strict=True))

    rows = [ok, changed(buckets_json="[[1000,1],[100,1]]"), changed(buckets_json="[[100,18446744073709551615],[1000,1]]"), changed(kind="x"),
            changed(ts_unix_ms=253402300800000), changed(buckets_json="[[1]]"), changed(labels_json="nope"), changed(name=None), changed(buckets_json="[]"),
            changed(raw=Decimal(2**64 - 1), buckets_json="[[5,18446744073709551615]]")]
    good, bad = validate_recording(spark.createDataFrame(rows, RECORDING))
    assert good.count() == 3
    assert sorted(r.reason for r in bad.collect()) == sorted(["bounds not increasing", "count overflow", "unknown kind", "timestamp out of range",
                                                             "malformed buckets", "malformed labels", "null value"])
    with pytest.raises(Exception, match="invalid recording"):
        validate_recording(spark.createDataFrame(rows, RECORDING), strict=True)[0].collect()


def test_codecs(spark):
    df = spark.createDataFrame([({"z": "1", "a": "2\n\"\\\t\u0001"}, [(10, 5), (30, 2)])], "l map<string,string>, b array<struct<bound:bigint,count:bigint>>")
    r = df.select(encode_labels("l").alias("lj"), encode_buckets("b").alias("bj")).select(
        "lj", "bj", decode_labels("lj").alias("l"), decode_buckets("bj").alias("b")).first()
    assert r.lj == '{"a":"2\\n\\"\\\\\\t\\u0001","z":"1"}' and r.bj == "[[10,5],[30,2]]"
    assert r.l == {"z": "1", "a": "2\n\"\\\t\u0001"} and [tuple(map(int, b)) for b in r.b] == [(10, 5), (30, 2)]


def test_tables(spark, tmp_path):
    df = snapshot(spark, SENT, ("tcp/rtt_us", {}, "distribution", "count", 7, []))
    write_samples(df, str(tmp_path / "samples"))
    rows = {r.name: r for r in spark.read.parquet(str(tmp_path / "samples")).collect()}
    assert rows["fabric_sent-octets"].p99 == 8191 and rows["fabric_sent-octets"].tags == {"lane": "q7"} and str(rows["fabric_sent-octets"].date) == "2024-01-01"
    assert rows["tcp_rtt_us"].p50 == 0, "an empty histogram rolls up as zero"
    for _ in range(2):
        write_recording(df, str(tmp_path / "rec"), "1 hour")
    assert read_recording(spark, str(tmp_path / "rec")).count() == 4
    assert load_session(spark, [str(tmp_path / "rec")]).count() == 2
    assert any(p.name.endswith(".snappy.parquet") for p in Path(tmp_path / "rec").rglob("*.parquet"))


def test_retention_and_versions(spark):
    df = spark.createDataFrame([(d,) for d in ("2024-01-01 23:00:00", "2024-01-02 00:00:00", "2024-01-30 00:00:00")], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert apply_retention(df, "2024-01-31 12:00:00").count() == 2
    versions = spark.createDataFrame([("h", 1, 1, "a"), ("h", 1, 3, "c"), ("h", 1, 2, "b"), ("h", 2, 1, "z")], "hostname string, ts int, version int, snapshot string")
    assert sorted(r.snapshot for r in latest_config_snapshot(versions).collect()) == ["c", "z"]


def test_captures_carry_host_and_time(spark, tmp_path):
    folder = tmp_path / "web1" / "1704067200000"
    folder.mkdir(parents=True)
    (folder / "loadavg").write_text("3.08 2.71 1.94 5/1407 61522\n")
    r = read_captures(spark, str(tmp_path)).first()
    assert (r.host, r.ts.timestamp()) == ("web1", 1704067200.0) or r.host == "web1"
