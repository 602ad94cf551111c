from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetpulse import (
    alias_fold, annotate, artifact_flags, attribute_changes, busiest_cores, change_note, change_tags, config_diff, config_values, coverage_gate,
    coverage_tuples, enrich_context, exclude_virtual, expected_active, field_mapping, flatten_config, keep_patterns, label_filter, multipath_head,
    name_filter, normalize_mask, page, queue_stat_fields, sanitize_name, series_key, service_port)
from fleetpulse.schema import CONFIG_STATE


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_service_port(spark):
    pairs = [(80, 54321), (54321, 443), (22, 9100), (54321, 60000), (40000, 443), (40000, 45000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s int, d int")
    assert [r.p for r in df.select("i", service_port("s", "d").alias("p")).orderBy("i").collect()] == [80, 443, 22, None, 443, None]


def test_queue_stat_names(spark):
    got = column(spark, ["rx3_packets", "rx_queue_12_bytes", "tx0_dropped", "rx_packets", "tx1_buff_alloc_err", "rx1_buff_alloc_err"], queue_stat_fields)
    assert [g and (g.direction, g.queue) for g in got] == [("rx", 3), ("rx", 12), ("tx", 0), None, None, ("rx", 1)]
    assert got[0].metric == "nic/queue/rx_packets"


def test_masks(spark):
    assert column(spark, ["00000000,0000f000", "00000000", "ffffffff,ffffffff", ""], normalize_mask) == ["f000", "0", "ffffffffffffffff", "0"]


def test_multipath_heads(spark):
    got = column(spark, ["nvme0c0n1", "nvme12c3n45", "nvme0n1", "sda", "nvme0cXn1"], multipath_head)
    assert got == ["nvme0n1", "nvme12n45", None, None, None]


def test_component_folds_only_under_a_known_head(spark):
    df = spark.createDataFrame([("nvme0c0n1", 5), ("nvme0c1n1", 6), ("nvme0n1", 1), ("nvme9c0n1", 7)], "device string, value bigint")
    heads = spark.createDataFrame([("nvme0n1",), ("sda",)], "device string")
    assert {r.device: r.value for r in alias_fold(df, heads).collect()} == {"nvme0n1": 12, "nvme9c0n1": 7}


def test_expected_active(spark):
    df = spark.createDataFrame([(64, 1), (1000, 1000), (0, 32), (64, 0), (63, 32), (63, 128), (63, 256)], "total int, flows int")
    got = [r.expected_active for r in expected_active(df).collect()]
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 632) < 1 and got[2] == 0 and got[3] == 0
    assert [round(g) for g in got[4:]] == [25, 55, 62]


def test_names_and_keys(spark):
    assert column(spark, ["net/tx-bytes"], lambda c: sanitize_name(c, "exposition")) == ["net_tx_bytes"]
    assert column(spark, ["net/tx-bytes"], lambda c: sanitize_name(c, "rollup")) == ["net_tx-bytes"]
    df = spark.createDataFrame([({"a": "2", "z": "1"}, {"z": "1", "a": "2"})], "x map<string,string>, y map<string,string>")
    r = df.select(series_key(F.lit("n"), "x").alias("a"), series_key(F.lit("n"), "y").alias("b"), series_key(F.lit("m"), "y").alias("c")).first()
    assert r.a == r.b != r.c


def test_artifacts(spark):
    rows = [(1, 2**39 - 1), (1, 2**20 - 1), (190, 204), (190, 350), (190, 195)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p50 bigint, p99 bigint")
    got = [r.f for r in df.select("i", artifact_flags("p50", "p99", F.lit(200)).alias("f")).orderBy("i").collect()]
    assert got == ["saturated", "saturated", "tail_artifact", "aliasing", "ok"]


def test_driver_stats_and_devices(spark):
    df = spark.createDataFrame([("rx_out_of_buffer",), ("rx_bytes",), ("a.crc_error-x",)], "stat_name string")
    assert sorted(r.metric for r in keep_patterns(df).collect()) == ["nic/driver/a_crc_error_x", "nic/driver/rx_out_of_buffer"]
    names = spark.createDataFrame([(n,) for n in ("lo", "lo1", "veth12", "docker0", "virbr0", "ens1f0")], "iface string")
    assert sorted(r.iface for r in exclude_virtual(names, iface="iface").collect()) == ["ens1f0", "lo1"]
    assert field_mapping(spark).count() == 65


def test_filters_treat_missing_labels_as_different(spark):
    df = spark.createDataFrame([("a", {"cpu": "cpu"}), ("b", {"cpu": "cpu1", "source": "ebpf"}), ("c", {}), ("d", {"cpu": "cpu2"})], "name string, tags map<string,string>")
    assert sorted(r.name for r in label_filter(df, differ={"cpu": "cpu"}).collect()) == ["b", "c", "d"]
    assert sorted(r.name for r in label_filter(df, absent=["source"]).collect()) == ["a", "c", "d"]
    assert [r.name for r in label_filter(df, {"cpu": "cpu2"}).collect()] == ["d"]
    odd = spark.createDataFrame([("a%b",), ("axb",)], "name string")
    assert [r.name for r in name_filter(odd, contains="a%").collect()] == ["a%b"]


def test_busiest_cores_break_ties_by_name(spark):
    rows = [("cpu_usage_softirq", {"cpu": f"cpu{i}"}, 5) for i in range(3)] + [("cpu_usage_user", {"cpu": "cpu9"}, 50), ("cpu_usage_softirq", {"cpu": "cpu"}, 99)]
    df = spark.createDataFrame(rows, "name string, tags map<string,string>, p99 bigint")
    assert [(r.cpu, r.softirq_p99, r.user_p99) for r in busiest_cores(df, top=4).collect()] == [
        ("cpu0", 5, 0), ("cpu1", 5, 0), ("cpu2", 5, 0), ("cpu9", 0, 50)]


def test_coverage_gate(spark):
    df = spark.createDataFrame([("a", {"y": "1", "x": "1"}, "gauge", "count"), ("b", {}, "gauge", "count")], "name string, labels map<string,string>, kind string, unit string")
    golden = coverage_tuples(df)
    assert golden.where("name = 'a'").first().label_keys == ["x", "y"]
    assert coverage_gate(golden, golden).count() == 0
    assert [r.name for r in coverage_gate(golden, golden.where("name = 'a'")).collect()] == ["b"]
    with pytest.raises(Exception, match="coverage lost"):
        coverage_gate(golden, golden.where("name = 'a'"), strict=True).collect()


def test_page_is_clamped_and_ordered(spark):
    df = spark.range(120).select(F.timestamp_micros(F.col("id") * 700_000).alias("ts"), F.lit("{}").alias("labels_key"), "id", F.col("id").alias("raw"))
    assert [r.id for r in page(df, 1, 50, chunk="9 s").orderBy("row").collect()] == list(range(50, 100))
    assert [r.id for r in page(df, 99, 50, chunk="9 s").orderBy("row").collect()] == list(range(100, 120))


# --- configuration ---------------------------------------------------------------

def attributed(spark, keys, events):
    changes = spark.createDataFrame([(1, k, "a", "b") for k in keys], "window_id bigint, key string, old_value string, new_value string")
    ev = spark.createDataFrame([(1, i, pid, comm, scope, arg) for i, (pid, comm, scope, arg) in enumerate(events)],
                               "window_id bigint, seq int, pid bigint, comm string, scope string, arg string")
    return {r.key: r.comm for r in attribute_changes(changes, ev).collect()}


def test_sysctl_changes_are_claimed_by_the_written_file(spark):
    events = [(200, "lldpd", "link", None), (100, "sysctl", "sysctl", "tcp_rmem")]
    assert attributed(spark, ["sysctl.tcp_rmem_max"], events) == {"sysctl.tcp_rmem_max": "sysctl"}
    other = [(1, "x", "sysctl", "rmem_max")]
    assert attributed(spark, ["sysctl.tcp_rmem_max", "sysctl.rmem_max"], other) == {"sysctl.tcp_rmem_max": "unknown", "sysctl.rmem_max": "x"}
    nested = [(1, "y", "sysctl", "rp_filter"), (2, "z", "sysctl", "")]
    assert attributed(spark, ["sysctl.conf.eth0.rp_filter", "ring.eth0.rx"], nested) == {"sysctl.conf.eth0.rp_filter": "y", "ring.eth0.rx": "unknown"}


def test_interface_changes_prefer_the_specific_event(spark):
    events = [(300, "lldpd", "link", None), (400, "ethtool", "iface", "ens1f0np0")]
    assert attributed(spark, ["ring.ens1f0np0.rx", "mtu.ens1f1np1", "channels.ens1f1np1.rx"], events) == {
        "ring.ens1f0np0.rx": "ethtool", "mtu.ens1f1np1": "lldpd", "channels.ens1f1np1.rx": "unknown"}
    wide = [(500, "ethtool", "ethtool_any", None)]
    assert attributed(spark, ["ring.ens1f0np0.rx", "channels.eth9.combined", "sysctl.tcp_rmem_max", "mtu.eth0"], wide) == {
        "ring.ens1f0np0.rx": "ethtool", "channels.eth9.combined": "ethtool", "sysctl.tcp_rmem_max": "unknown", "mtu.eth0": "unknown"}
    both = [(1, "generic", "ethtool_any", None), (2, "specific", "iface", "eth0")]
    assert attributed(spark, ["ring.eth0.rx"], both) == {"ring.eth0.rx": "specific"}


def test_steering_changes_belong_to_steering_events(spark):
    events = [(1, "lldpd", "iface", "ens1f0np0"), (0, "fswatch", "steering", None)]
    keys = ["rps.ens1f0np0.rx-3", "xps.ens1f0np0.tx-0", "irq.ens1f0np0.211", "ring.ens1f0np0.rx", "sysctl.rmem_max"]
    assert attributed(spark, keys, events) == dict(zip(keys, ["fswatch"] * 3 + ["lldpd", "unknown"]))
    assert attributed(spark, ["rps.ens1f0np0.rx-0"], events[:1]) == {"rps.ens1f0np0.rx-0": "unknown"}


def test_notes(spark):
    rows = [("ring.ens1f1np1.rx", "1024", "8192", "ring.rx: 1024 → 8192  (ens1f1np1)"), ("mtu.ens1f1np1", "1500", "9000", "MTU: 1500 → 9000  (ens1f1np1)"),
            ("sysctl.tcp_rmem_max", "6291456", "16777216", "sysctl.tcp_rmem_max: 6291456 (6MB) → 16777216 (17MB)"),
            ("sysctl.tcp_slow_start_after_idle", "1", "0", "sysctl.tcp_slow_start_after_idle: 1 → 0"),
            ("rss.eth0.table_size", "64", "128", "rss.table_size: 64 → 128  (eth0)"), ("rps.eth0.rx-1", "f", "0", "rps.eth0.rx-1: f → 0")]
    df = spark.createDataFrame(rows, "k string, o string, n string, want string")
    for r in df.select("want", change_note("k", "o", "n").alias("note")).collect():
        assert r.note == r.want


def test_annotation_tags(spark):
    rows = [("sysctl:tcp_rmem", "4096 131072 6291456", "4096 131072 16777216"), ("ring:eth0:rx", "1", "2"), ("mtu:eth0", "1", "2"), ("other", "1", "2")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, o string, n string")
    got = [r.t for r in df.select("i", change_tags("k", "o", "n").alias("t")).orderBy("i").collect()]
    assert got[0].text == "tcp_rmem:  min=4K / default=128K / max=6144K  →  min=4K / default=128K / max=16384K"
    assert got[0].tags == ["sysconfig", "sysctl", "tcp-buffers"]
    assert (got[1].text, got[1].tags) == ("ring.rx: 1 → 2  (eth0)", ["sysconfig", "ring", "eth0"])
    assert (got[2].text, got[2].tags) == ("MTU: 1 → 2  (eth0)", ["sysconfig", "mtu", "eth0"])
    assert (got[3].text, got[3].tags) == ("other: 1 → 2", ["sysconfig"])


def test_only_adjacent_snapshots_are_compared(spark):
    rows = [("h", 1, "a", "1"), ("h", 1, "b", "1"), ("h", 2, "a", "2"), ("h", 3, "a", "2"), ("h", 3, "b", "9"), ("h", 3, "new", "x"), ("g", 1, "a", "7")]
    df = spark.createDataFrame(rows, "hostname string, snapshot bigint, key string, value string")
    for chunk in (None, 1, 10):
        got = [(r.snapshot, r.key, r.old_value, r.new_value) for r in config_diff(df, chunk=chunk).collect()]
        assert got == [(2, "a", "1", "2")]
    for kind in ("bigint", "string", "timestamp"):  # the default: chunks of numbers, of days, or none
        typed = df.withColumn("snapshot", F.timestamp_seconds(F.col("snapshot") * 50_000) if kind == "timestamp" else F.col("snapshot").cast(kind))
        assert [(r.key, r.old_value, r.new_value) for r in config_diff(typed).collect()] == [("a", "1", "2")]


def test_numeric_values_only(spark):
    df = spark.createDataFrame([("f000",), ("1e5",), ("9000",), ("cubic",)], "value string")
    assert sorted(r.value for r in config_values(df).collect()) == [9000.0, 100000.0]


def test_flatten(spark):
    steering = ([(0, "f000"), (1, "0")], [(3, "ff")], [(211, "4")])
    iface = ("mlx5", "1", "2", "pci", 9000, 8192, 1024, 8192, 2048, 31, 32, 63, 64, 128, 8, 16, 1, steering)
    sysctl = ([4096, 131072, 6291456], [4096, 16384, 4194304], 212992, 212993, 1, 2, 1000, 128, 64, 1, 0, "cubic")
    df = spark.createDataFrame([(1000, "h", "6.1", sysctl, {"eth0": iface})], CONFIG_STATE)
    got = {r.key: r.value for r in flatten_config(df).collect()}
    assert len(got) == 7 + 12 + 4
    assert got["sysctl.tcp_rmem_max"] == "6291456" and got["sysctl.tcp_congestion_control"] == "cubic"
    assert got["ring.eth0.rx"] == "1024" and got["mtu.eth0"] == "9000" and got["channels.eth0.combined"] == "63"
    assert got["sysctl.conf.eth0.rp_filter"] == "1" and got["rps.eth0.rx-0"] == "f000" and got["xps.eth0.tx-3"] == "ff" and got["irq.eth0.211"] == "4"


def test_context_is_the_one_valid_at_the_time(spark):
    obs = spark.createDataFrame([("eth0", 5), ("eth0", 15), ("eth0", 25), ("eth1", 5)], "iface string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    ctx = spark.createDataFrame([("eth0", 10, "mlx5", 1500), ("eth0", 20, "mlx5", 9000)], "iface string, s bigint, driver string, mtu int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {(r.iface, r.s): (r.driver, r.mtu) for r in enrich_context(obs, ctx, chunk="10 s").collect()}
    assert got == {("eth0", 5): ("", ""), ("eth0", 15): ("mlx5", "1500"), ("eth0", 25): ("mlx5", "9000"), ("eth1", 5): ("", "")}


def test_annotation_range_is_inclusive(spark):
    obs = spark.range(0, 200).select(F.timestamp_seconds("id").alias("ts"), "id")
    changes = spark.createDataFrame([(1, 60), (2, 61)], "change int, s bigint").withColumn("change_ts", F.timestamp_seconds("s"))
    rows = annotate(obs, changes, "10 s", "20 s").collect()
    assert sorted((r.change, r.id) for r in rows) == [(1, i) for i in range(50, 81)] + [(2, i) for i in range(51, 82)]
    assert Decimal(1) == 1
