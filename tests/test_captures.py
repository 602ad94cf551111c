from pyspark.sql import functions as F

from fleetpulse.sources.captures import ingest_disk_text

from fleetpulse import (
    exposition_tuples, field_map, ingest_entity_table_text, ingest_exposition_text, ingest_header_pair_text, ingest_kv_text, ingest_matrix_text,
    ingest_pair_text, ingest_pressure_load_text)

# Captures of an invented machine, in the kernel's text formats.
DISKSTATS = " 259       0 nvme3n1 731 12 44016 219 90 7 5136 61 1 305 281\n 253       4 dm-4 48 0 392 17 11 0 88 6 0 21 23"
MEMINFO = "MemTotal:       65843220 kB\nMemFree:        17290436 kB\nVmallocTotal:   13743895347199 kB\nHugePages_Total:       41"
NET_DEV = """Inter-|   Receive                                                |  Transmit
 face |bytes    packets errs drop fifo frame compressed multicast|bytes    packets errs drop fifo colls carrier compressed
ens7f1: 8812345  7703    2   19    0     0          0        31   640912   5120    1    3    0     0       0          0
  wg2:  71828     64    0    0    0     0          0         0    31415     59    0    0    0     0       0          0"""
SNMP = """Tcp: RtoAlgorithm RtoMin RtoMax MaxConn ActiveOpens PassiveOpens AttemptFails EstabResets CurrEstab InSegs OutSegs RetransSegs InErrs OutRsts InCsumErrors
Tcp: 1 200 120000 -1 7319 884 61 27 143 950211 871034 306 9 77 0
Udp: InDatagrams NoPorts InErrors OutDatagrams RcvbufErrors SndbufErrors InCsumErrors IgnoredMulti
Udp: 41877 93 2 40015 1 0 0 58"""
SNMP6 = "Ip6InReceives                   \t773401\nIp6FragFails                    \t37\nIcmp6InPktTooBigs               \t14\nUdp6NoPorts                     \t8"
SOCKSTAT = "sockets: used 1931\nTCP: inuse 407 orphan 9 tw 66 alloc 512 mem 83\nUDP: inuse 21 mem 17\nUDPLITE: inuse 0"
SOFTIRQS = """                    CPU0       CPU1       CPU2
       TIMER:     812077     650413     700021
      NET_TX:        391          7        118
      NET_RX:     455190    1203344      98765"""
STAT = "cpu  9120 33 2871 70415 402 0 118 6 0 0\ncpu0 5003 20 1500 35007 300 0 101 2 0 0\ncpu1 4117 13 1371 35408 102 0 17 4 0 0\nintr 88172\nctxt 240551"
PRESSURE = "some avg10=1.37 avg60=0.92 avg300=0.41 total=7730188\nfull avg10=0.66 avg60=0.29 avg300=0.17 total=3120467"


def lines(spark, text, path="capture"):
    rows = [("h", path, line) for line in text.split("\n")]
    return spark.createDataFrame(rows, "host string, path string, value string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def values(df):
    return {(r.name, *sorted(r.labels.items())): int(r.raw) for r in df.collect()}



def test_values_beyond_64_bits_give_no_row(spark):
    big = spark.createDataFrame([("h", None, "meminfo", x) for x in ("A: 18446744073709551615 kB", "B: 99999999999999999999", "C: 18446744073709551615", "D: 2 kB")],
                                "host string, ts timestamp, path string, value string")
    assert {r.name: int(r.raw) for r in ingest_kv_text(big).collect()} == {"memory/c": 2**64 - 1, "memory/d": 2048}
    disk = spark.createDataFrame([("h", None, "diskstats", f"8 0 sda 1 2 {2**64 - 1} 4 5 6 3 8")], "host string, ts timestamp, path string, value string")
    assert [(r.name, int(r.raw)) for r in ingest_disk_text(disk).collect()] == [("disk/write/bytes", 1536)]


def test_cpu_lines(spark):
    got = values(ingest_entity_table_text(lines(spark, STAT, "proc_stat")))
    assert len(got) == 3 * 8
    assert got[("cpu/usage/user", ("cpu", "cpu"))] == 9120 and got[("cpu/usage/system", ("cpu", "cpu0"))] == 1500


def test_short_cpu_line_is_padded(spark):
    got = values(ingest_entity_table_text(lines(spark, "cpu0 21 3 14 880 6 1 9\ncpu1 18 2 11 902 5 4"), "cpu"))
    assert len(got) == 8 and got[("cpu/usage/steal", ("cpu", "cpu0"))] == 0


def test_memory(spark):
    got = values(ingest_kv_text(lines(spark, MEMINFO)))
    assert got[("memory/memfree",)] == 17290436 * 1024 and got[("memory/hugepages_total",)] == 41
    assert ("memory/vmalloctotal",) not in got


def test_interfaces_and_disks(spark):
    got = values(ingest_entity_table_text(lines(spark, NET_DEV, "proc_net_dev").unionByName(lines(spark, DISKSTATS, "proc_diskstats"))))
    assert got[("network/receive/bytes", ("iface", "ens7f1"))] == 8812345 and got[("network/transmit/bytes", ("iface", "ens7f1"))] == 640912
    assert got[("network/receive/dropped", ("iface", "ens7f1"))] == 19
    assert got[("disk/read/bytes", ("device", "nvme3n1"))] == 44016 * 512 and got[("disk/write/bytes", ("device", "dm-4"))] == 88 * 512
    assert len(got) == 2 * 6 + 2 * 2


def test_protocol_counters(spark):
    parsed = ingest_header_pair_text(lines(spark, SNMP))
    got = {(r.proto, r.field): int(r.value) for r in parsed.collect()}
    assert got[("Tcp", "ActiveOpens")] == 7319 and got[("Tcp", "InSegs")] == 950211
    assert got[("Udp", "InDatagrams")] == 41877 and got[("Udp", "NoPorts")] == 93
    assert ("Tcp", "MaxConn") not in got, "negative values are dropped"
    named = {r.metric: int(r.value) for r in field_map(parsed.unionByName(ingest_pair_text(lines(spark, SNMP6)))).collect()}
    assert named["tcp/retrans/segs"] == 306 and named["ip6/frag/failures"] == 37 and named["icmp6/in_pkt_too_big"] == 14
    assert "Ip6InReceives" not in named


def test_load_pressure_and_sockets(spark):
    text = lines(spark, "3.08 2.71 1.94 5/1407 61522", "proc_loadavg").unionByName(lines(spark, PRESSURE, "proc_pressure_memory")).unionByName(
        lines(spark, "some avg10=4.05 avg60=2.83 avg300=0.07 total=9904412", "proc_pressure_cpu")).unionByName(lines(spark, SOCKSTAT, "proc_sockstat"))
    got = {k[0]: v for k, v in values(ingest_pressure_load_text(text)).items()}
    assert [got[f"cpu/load/{n}"] for n in ("load1", "load5", "load15")] == [308, 271, 194]
    assert [got[f"psi/cpu/some_{a}"] for a in ("avg10", "avg60", "avg300")] == [405, 283, 7] and "psi/cpu/full_avg10" not in got
    assert got["psi/memory/some_avg60"] == 92 and got["psi/memory/full_avg60"] == 29
    assert (got["net/sockets/tcp_inuse"], got["net/sockets/tcp_tw"], got["net/sockets/tcp_orphan"], got["net/sockets/udp_inuse"]) == (407, 66, 9, 21)


def test_matrix(spark):
    got = {k[0]: v for k, v in values(ingest_matrix_text(lines(spark, SOFTIRQS))).items()}
    assert got == {"softirq/timer": 2_162_511, "softirq/net_tx": 516, "softirq/net_rx": 1_757_299}


def test_exposition_tuples(spark):
    text = "\n".join(['# TYPE fan_turns counter', 'fan_turns{slot="3",side="rear"} 1810', 'fan_turns_rate{slot="3",side="rear",percentile="99"} 64',
                      'swap_free_value{} 733', 'tape_read_rate{drive="lto1"} 29 1706543210987', 'link_octets{route="x,y",iface="bond4"} 51',
                      'probe_value_value{site="oslo"} 12', ""])
    parsed = ingest_exposition_text(lines(spark, text))
    got = {(r.name, tuple(r.label_keys)) for r in exposition_tuples(parsed).collect()}
    assert got == {("fan_turns", ("side", "slot")), ("swap_free", ()), ("tape_read", ("drive",)), ("link_octets", ("iface", "route")), ("probe_value", ("site",))}
    r = parsed.where("name = 'tape_read'").first()
    assert (r.value, r.sample_ms) == (29.0, 1706543210987)
    assert parsed.where("name = 'link_octets'").first().labels["route"] == "x,y"
