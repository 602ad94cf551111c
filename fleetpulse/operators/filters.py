"""Row selection: plain predicates, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.durations import micros
from fleetpulse.functions.text import sanitize_name

# Fragments of driver statistic names worth keeping.
KEEP_PATTERNS = (
    "out_of_buffer",
    "discards_phy",
    "steer_missed",
    "rx_missed",
    "rx_fifo",
    "crc_error",
    "pci_signal",
)

# Devices that are not physical.
VIRTUAL_INTERFACES = r"^(lo$|veth|docker|virbr)"
VIRTUAL_DISKS = r"^(loop|ram|zram)"

# Kernel counter fields and the metrics they become.
FIELD_MAP = {
    "Ip": {
        "ip/reasm/requests": "ReasmReqds",
        "ip/reasm/ok": "ReasmOKs",
        "ip/reasm/failures": "ReasmFails",
        "ip/frag/ok": "FragOKs",
        "ip/frag/failures": "FragFails",
        "ip/frag/created": "FragCreates",
        "ip/in_discards": "InDiscards",
        "ip/out_discards": "OutDiscards",
        "ip/out_no_routes": "OutNoRoutes",
        "ip/in_hdr_errors": "InHdrErrors",
    },
    "Icmp": {
        "icmp/in_dest_unreachable": "InDestUnreachs",
        "icmp/in_time_exceeded": "InTimeExcds",
        "icmp/out_dest_unreachable": "OutDestUnreachs",
    },
    "Tcp": {
        "tcp/active_opens": "ActiveOpens",
        "tcp/passive_opens": "PassiveOpens",
        "tcp/in_segs": "InSegs",
        "tcp/out_segs": "OutSegs",
        "tcp/retrans/segs": "RetransSegs",
    },
    "Udp": {
        "udp/in_datagrams": "InDatagrams",
        "udp/out_datagrams": "OutDatagrams",
        "udp/in_errors": "InErrors",
        "udp/no_ports": "NoPorts",
        "udp/rcvbuf_errors": "RcvbufErrors",
        "udp/sndbuf_errors": "SndbufErrors",
    },
    "Ip6": {
        "ip6/reasm/requests": "Ip6ReasmReqds",
        "ip6/reasm/ok": "Ip6ReasmOKs",
        "ip6/reasm/failures": "Ip6ReasmFails",
        "ip6/frag/ok": "Ip6FragOKs",
        "ip6/frag/failures": "Ip6FragFails",
        "ip6/frag/created": "Ip6FragCreates",
        "ip6/in_discards": "Ip6InDiscards",
        "ip6/out_discards": "Ip6OutDiscards",
        "ip6/out_no_routes": "Ip6OutNoRoutes",
        "ip6/in_hdr_errors": "Ip6InHdrErrors",
    },
    "Icmp6": {
        "icmp6/in_pkt_too_big": "Icmp6InPktTooBigs",
        "icmp6/in_dest_unreachable": "Icmp6InDestUnreachs",
        "icmp6/in_time_exceeded": "Icmp6InTimeExcds",
        "icmp6/out_dest_unreachable": "Icmp6OutDestUnreachs",
    },
    "Udp6": {
        "udp6/in_datagrams": "Udp6InDatagrams",
        "udp6/out_datagrams": "Udp6OutDatagrams",
        "udp6/in_errors": "Udp6InErrors",
        "udp6/no_ports": "Udp6NoPorts",
        "udp6/rcvbuf_errors": "Udp6RcvbufErrors",
        "udp6/sndbuf_errors": "Udp6SndbufErrors",
    },
    "TcpExt": {
        "tcp/retrans/fast": "TCPFastRetrans",
        "tcp/retrans/slow_start": "TCPSlowStartRetrans",
        "tcp/retrans/syn": "TCPSynRetrans",
        "tcp/retrans/fail": "TCPRetransFail",
        "tcp/retrans/spurious_rto": "TCPSpuriousRTOs",
        "tcp/window/zero_sent": "TCPToZeroWindowAdv",
        "tcp/window/zero_recv": "TCPFromZeroWindowAdv",
        "tcp/drop/listen": "ListenDrops",
        "tcp/drop/listen_overflow": "ListenOverflows",
        "tcp/drop/backlog": "TCPBacklogDrop",
        "tcp/drop/rcvq": "TCPRcvQDrop",
        "tcp/drop/ofo": "TCPOFODrop",
        "tcp/abort/timeout": "TCPAbortOnTimeout",
        "tcp/abort/close": "TCPAbortOnClose",
        "tcp/ofo/queued": "TCPOFOQueue",
        "tcp/ofo/merged": "TCPOFOMerge",
        "tcp/rcv_collapsed": "TCPRcvCollapsed",
        "tcp/dsack/old_sent": "TCPDSACKOldSent",
        "tcp/dsack/ofo_sent": "TCPDSACKOfoSent",
        "tcp/dsack/recv": "TCPDSACKRecv",
        "tcp/mem_pressure/events": "TCPMemoryPressures",
    },
}


def lookback(df: DataFrame, as_of, minutes: float = 5, until=None, ts: str = "ts") -> DataFrame:
    """Rows not older than ``minutes`` before ``as_of``; ``until`` closes the range, inclusive."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    start = F.timestamp_micros(F.unix_micros(as_of) - F.lit(micros(minutes * 60)))
    df = df.where(F.col(ts) >= start)
    return df if until is None else df.where(F.col(ts) <= F.lit(until).cast("timestamp"))


def label_filter(df: DataFrame, equal: Mapping[str, str] | None = None, absent: Sequence[str] = (),
                 differ: Mapping[str, str] | None = None, labels: str = "tags") -> DataFrame:
    """All conditions must hold. An absent key equals nothing and differs from everything."""
    for key, value in (equal or {}).items():
        df = df.where(F.try_element_at(labels, F.lit(key)).eqNullSafe(F.lit(value)))
    for key, value in (differ or {}).items():
        df = df.where(~F.try_element_at(labels, F.lit(key)).eqNullSafe(F.lit(value)))
    for key in absent:
        df = df.where(~F.map_contains_key(labels, key))
    return df


def name_filter(df: DataFrame, equal: str | None = None, any_of: Sequence[str] | None = None,
                contains: str | None = None, icontains: str | None = None, name: str = "name") -> DataFrame:
    """Selection by metric name; the substrings are literal text, not patterns."""
    if equal is not None:
        df = df.where(F.col(name) == equal)
    if any_of is not None:
        df = df.where(F.col(name).isin(*any_of))
    if contains:
        df = df.where(F.col(name).contains(contains))
    if icontains:
        df = df.where(F.lower(name).contains(icontains.lower()))
    return df


def keep_patterns(df: DataFrame, name: str = "stat_name") -> DataFrame:
    """Driver statistics worth keeping, with their metric name."""
    return (df.where(F.col(name).rlike("|".join(KEEP_PATTERNS)))
            .withColumn("metric", F.concat(F.lit("nic/driver/"), sanitize_name(name, "driver"))))


def exclude_virtual(df: DataFrame, iface: str | None = None, disk: str | None = None) -> DataFrame:
    if iface:
        df = df.where(~F.col(iface).rlike(VIRTUAL_INTERFACES))
    if disk:
        df = df.where(~F.col(disk).rlike(VIRTUAL_DISKS))
    return df


def field_mapping(spark, mapping: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """The mapping as a DataFrame of (proto, field, metric)."""
    rows = [(proto, field, metric) for proto, fields in (mapping or FIELD_MAP).items()
            for metric, field in fields.items()]
    return spark.createDataFrame(rows, "proto string, field string, metric string")


def field_map(df: DataFrame, mapping: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Rename (proto, field) rows to metrics; other fields vanish.

    The mapping is a constant of the program, so its broadcast does not grow with the data.
    """
    return df.join(F.broadcast(field_mapping(df.sparkSession, mapping)), ["proto", "field"])
