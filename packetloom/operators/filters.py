"""Predicates over packets. Every leaf is two-valued: a comparison on a missing field is false before anything negates it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import matching

COMPARISONS = {"eq": "==", "ne": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}
# Transport class, rank among the protocols of a flow and whether it is AI traffic.
PROTOCOLS = (
    ("TCP", "tcp", 1, False), ("UDP", "udp", 1, False), ("ICMP", "icmp", 1, False), ("ARP", "arp", 1, False),
    ("HTTP", "tcp", 5, False), ("TLS", "tcp", 4, False), ("DNS", "udp", 5, False), ("SSH", "tcp", 5, False), ("SMB", "tcp", 5, False),
    ("RDP", "tcp", 5, False), ("NTP", "udp", 5, False), ("MODBUS", "tcp", 5, False), ("QUIC", "udp", 4, False), ("OPENAI", "tcp", 6, True), ("OLLAMA", "tcp", 6, True),
)


def two_valued(leaf: Column) -> Column:
    return F.coalesce(leaf, F.lit(False))


def compare(left: Column, op: str, right) -> Column:
    right = right if isinstance(right, Column) else F.lit(right)
    out = {"eq": left == right, "ne": left != right, "gt": left > right, "lt": left < right, "ge": left >= right, "le": left <= right}
    if op not in out:
        raise ValueError(f"unknown comparison {op!r}")
    return two_valued(out[op])


def all_of(*leaves: Column) -> Column:
    return reduce(lambda a, b: a & b, leaves, F.lit(True))


def any_of(*leaves: Column) -> Column:
    return reduce(lambda a, b: a | b, leaves, F.lit(False))


def either_address(op: str, address: str, src: str = "src", dst: str = "dst") -> Column:
    """eq: either end is the address; ne: neither end is, both being known."""
    a, b = F.col(src) == address, F.col(dst) == address
    if op == "eq":
        return two_valued(a) | two_valued(b)
    return two_valued(~a) & two_valued(~b) if op == "ne" else F.lit(False)


def one_address(column: str, op: str, value: str) -> Column:
    """eq, ne or contains on one end; ordering comparisons on addresses are false."""
    if op == "contains":
        return two_valued(F.col(column).contains(value))
    return compare(F.col(column), op, value) if op in ("eq", "ne") else F.lit(False)


def transport(protocol: str = "protocol") -> Column:
    """Transport class of a protocol: tcp, udp, icmp, arp or other."""
    out = F.lit("other")
    for kind in ("tcp", "udp", "icmp", "arp"):
        out = F.when(F.upper(protocol).isin([p[0] for p in PROTOCOLS if p[1] == kind]), kind).otherwise(out)
    return out


def protocol_rank(protocol: str = "protocol") -> Column:
    out = F.lit(0)
    for rank in sorted({p[2] for p in PROTOCOLS}):
        out = F.when(F.upper(protocol).isin([p[0] for p in PROTOCOLS if p[2] == rank]), rank).otherwise(out)
    return out


def either_port(op: str, port: int, want: str | None = None, sport: str = "sport", dport: str = "dport", protocol: str = "protocol") -> Column:
    """A comparison that holds for either port; ne holds if neither is the port. want: only for this transport class."""
    a, b = compare(F.col(sport), op, port), compare(F.col(dport), op, port)
    out = a & b if op == "ne" else a | b
    return out & (transport(protocol) == want) if want else out


def frame_length(op: str, value, length: str = "length") -> Column:
    """Numeric comparison; contains looks for the digits."""
    if op == "contains":
        return two_valued(F.col(length).cast("string").contains(str(value)))
    return compare(F.col(length), op, value)


# Bits of the TCP flags byte.
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16}


def tcp_flag(name: str, op: str, value: int, flags: str = "flags") -> Column:
    return compare(F.col(flags).bitwiseAND(TCP_FLAGS[name]).cast("boolean").cast("int"), op, value)


def text_leaf(column: Column | str, op: str, value: str) -> Column:
    """eq, ne, contains without regard to case; ordering on text is false."""
    left = F.lower(F.col(column) if isinstance(column, str) else column)
    if op == "contains":
        return two_valued(left.contains(value.lower()))
    return compare(left, op, value.lower()) if op in ("eq", "ne") else F.lit(False)


def protocol_is(name: str, protocol: str = "protocol", src: str = "src") -> Column:
    """ip, ipv4, ipv6 (by address), a transport class, ai_traffic, or one protocol."""
    low = name.lower()
    if low in ("ip", "ipv4", "ipv6"):
        six = two_valued(F.col(src).contains(":"))
        return two_valued(F.col(src).isNotNull()) & {"ip": F.lit(True), "ipv4": ~six, "ipv6": six}[low]
    if low in ("tcp", "udp", "icmp", "arp"):
        return transport(protocol) == low
    if low == "ai_traffic":
        return two_valued(F.upper(protocol).isin([p[0] for p in PROTOCOLS if p[3]]))
    return text_leaf(protocol, "eq", name)


def free_text(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Rows whose summary, protocol, an address or the known name of an end holds the text. names: (ip, name), one row per ip."""
    a, b = names.select(F.col("ip").alias("src"), F.col("name").alias("_src_name")), names.select(F.col("ip").alias("dst"), F.col("name").alias("_dst_name"))
    joined = rows.join(a, "src", "left").join(b, "dst", "left")
    hit = any_of(*(text_leaf(c, "contains", text) for c in ("summary", "protocol", "src", "dst", "_src_name", "_dst_name")))
    return joined.where(hit).drop("_src_name", "_dst_name")


HUNT_FIELDS = ("event_type", "severity", "protocol", "source_ip", "dest_ip", "port", "title", "description")


def hunt(tree: dict, fields: dict[str, str] | None = None, typed: bool = False) -> Column:
    """A hunt tree as a Column: {"op": "AND" | "OR" | "NOT", "items": [...]} or {"field", "cmp", "value"}.

    NOT negates the disjunction of its items; an empty group is true. Values are compared as text unless typed. Unknown fields
    and operators raise ValueError.
    """
    if "op" in tree:
        items = [hunt(t, fields, typed) for t in tree["items"]]
        if not items:
            return F.lit(True)
        return {"AND": all_of, "OR": any_of, "NOT": lambda *x: ~any_of(*x)}[tree["op"]](*items)
    names = fields or {f: f for f in HUNT_FIELDS}
    if tree["field"] not in names:
        raise ValueError(f"unknown field {tree['field']!r}")
    column, op, value = F.col(names[tree["field"]]), tree["cmp"], tree["value"]
    left, right = (column, F.lit(value)) if typed else (column.cast("string"), F.lit(str(value)))
    if op == "contains":
        return two_valued(F.lower(column.cast("string")).contains(str(value).lower()))
    if op == "in":
        return two_valued(left.isin(list(value) if typed else [str(v) for v in value]))
    return compare(left, op, right)


def event_list(rows: DataFrame, severity: str | None = None, sensor: str | None = None, kind: str | None = None, since: int | None = None, until: int | None = None, time: str = "us") -> DataFrame:
    """Filter by severity, sensor, type and an inclusive range of times; None means any."""
    for name, value in (("severity", severity), ("sensor", sensor), ("kind", kind)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since is not None:
        rows = rows.where(F.col(time) >= since)
    return rows if until is None else rows.where(F.col(time) <= until)


def match_rules(events: DataFrame, rules: DataFrame, fields: tuple[str, ...] = ("kind", "protocol", "dport")) -> DataFrame:
    """Events with each enabled rule whose given fields all agree; a field that the rule leaves null matches anything.

    rules: (rule_id, enabled, *fields), joined by the pattern of fields that they set."""
    return matching.by_pattern(events, rules.where("enabled"), {f: f for f in fields}, ["rule_id"])


def minute_of_day(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def time_in_range(minute: Column, start: str, end: str) -> Column:
    """Whether a minute of the day lies in start..end, both included; a range may wrap over midnight."""
    a, b = minute_of_day(start), minute_of_day(end)
    return minute.between(a, b) if a <= b else (minute >= a) | (minute <= b)


PRESETS = {
    "off_hours": lambda: (F.col("hour") < 6) | (F.col("hour") > 20),
    "high_anomaly": lambda: two_valued(F.col("score") > 75),
    "unsigned_smb": lambda: (F.col("protocol") == "SMB") & ~two_valued(F.lower("summary").contains("signed")),
    "odd_dns": lambda: (F.col("protocol") == "DNS") & ((F.length("summary") > 60) | scalars.has_token(F.col("summary"), "TXT")),
    "subnet_hours": lambda: scalars.in_network(F.col("src"), "10.1.0.0/16") & F.col("hour").between(8, 18),
}


def pivot_by(rows: DataFrame, column: str, value, order: str = "seq") -> DataFrame:
    """The timeline of one value of one column, oldest first."""
    return rows.where(F.col(column) == value).orderBy("us", order)


def without_listed(rows: DataFrame, listed: DataFrame, on: str, listed_on: str | None = None) -> DataFrame:
    """Rows whose value is not on a list (whitelist, suppression); a null value is kept."""
    return rows.join(listed.select(F.col(listed_on or on).alias(on)).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


# Ports of discovery protocols and hosts of updates and telemetry.
NOISE_PORTS = (67, 68, 123, 137, 138, 1900, 5353, 5355)
NOISE_HOSTS = "(^|[.])(windowsupdate|update|telemetry|ocsp|crl|gvt1)[.]"


def is_noise(dport: str = "dport", host: str = "summary") -> Column:
    return two_valued(F.col(dport).isin(*NOISE_PORTS)) | two_valued(F.lower(host).rlike(NOISE_HOSTS))
