"""Columns and rows derived from one packet: header fields, severity, findings, payload class, attack techniques, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import has_token
from . import filters


def _u16(data: Column, at) -> Column:
    return F.conv(F.hex(F.substring(data, at, 2)), 16, 10).cast("int")


def frame_headers(frames: DataFrame, data: str = "data") -> DataFrame:
    """Adds l3, src, dst, proto_number, sport, dport, tcp_flags and payload to Ethernet frames; VLAN tags are skipped, short frames
    give nulls. Only binary functions of the engine are used."""
    d, start, l4, kind, number = F.col(data), F.col("_start"), F.col("_l4"), F.col("_kind"), F.col("proto_number")
    digits = F.col("_hex")
    cut = lambda at, n: F.substr(digits, 2 * at - 1, F.lit(2 * n))
    number_at = lambda at, n: F.conv(cut(at, n), 16, 10).cast("int")
    byte, word = (lambda at: number_at(at, 1)), (lambda at: number_at(at, 2))
    dotted = lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: number_at(at + i, 1).cast("string")), ".")
    colons = lambda at: F.regexp_replace(F.lower(cut(at, 16)), "(....)(?!$)", "$1:")
    four, six, ported = kind == "0800", kind == "86DD", number.isin(6, 17)
    tags = digits.substr(25, 4).isin("8100", "88A8"), digits.substr(33, 4).isin("8100", "88A8")
    # Each step is a projection of its own, so that no offset is computed twice.
    out = frames.withColumn("_hex", F.hex(F.substring(d, 1, 160)))
    out = out.withColumn("_start", F.when(tags[0] & tags[1], 23).when(tags[0], 19).otherwise(15))  # first byte after the EtherType
    out = out.withColumn("_kind", cut(start - 2, 2))
    out = out.withColumns({"_l4": F.when(four, start + F.pmod(byte(start), F.lit(16)) * 4).when(six, start + 40), "proto_number": F.when(four, byte(start + 9)).when(six, byte(start + 6))})
    out = out.withColumn("_body", F.when(number == 6, l4 + F.floor(byte(l4 + 12) / 16).cast("int") * 4).when(number == 17, l4 + 8))
    return out.withColumns(
        {
            "l3": F.when(four, "IPv4").when(six, "IPv6").when(kind == "0806", "ARP"),
            "src": F.when(four, dotted(start + 12)).when(six, colons(start + 8)),
            "dst": F.when(four, dotted(start + 16)).when(six, colons(start + 24)),
            "sport": F.when(ported, word(l4)),
            "dport": F.when(ported, word(l4 + 2)),
            "tcp_flags": F.when(number == 6, byte(l4 + 13)),
            "payload": F.when(ported, d.substr(F.col("_body"), F.length(d))),
        }
    ).drop("_hex", "_start", "_kind", "_l4", "_body")


def dns_question(payload: Column) -> Column:
    """First question name of a DNS message: labels from byte 13 on, without compression, 255 bytes at most; else null."""
    digits = F.hex(F.substring(payload, 13, 256))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("name"), F.lit(False).alias("done"), F.lit(True).alias("ok"))

    def step(s: Column, _: Column) -> Column:
        size = F.conv(F.substr(digits, s["at"] * 2 + 1, F.lit(2)), 16, 10).cast("int")
        label = F.decode(F.unhex(F.substr(digits, s["at"] * 2 + 3, size * 2)), "UTF-8")
        stop = s["done"] | ~s["ok"] | (F.coalesce(size, F.lit(0)) == 0)
        return F.struct(
            F.when(stop, s["at"]).otherwise(s["at"] + size + 1).alias("at"),
            F.when(stop, s["name"]).when(s["name"] == "", label).otherwise(F.concat(s["name"], F.lit("."), label)).alias("name"),
            (s["done"] | (size == 0)).alias("done"),
            (s["ok"] & F.when(s["done"], True).otherwise(F.coalesce(size < 64, F.lit(False)))).alias("ok"),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(64)), state, step)
    return F.when(end["ok"] & end["done"] & (end["name"] != "") & (end["at"] <= 255), end["name"])


def http_fields(payload: Column) -> dict[str, Column]:
    """method, uri, host and status from the first 2 KiB of a payload; null where absent."""
    head = F.decode(F.substring(payload, 1, 2048), "UTF-8")
    some = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    return {"method": some(r"^([A-Z]{3,7}) \S+ HTTP/1\."), "uri": some(r"^[A-Z]{3,7} (\S+) HTTP/1\."), "host": some(r"(?i)\r\nHost:[ \t]*([^\r\n]+)"), "status": some(r"^HTTP/1\.[01] ([0-9]{3})").cast("int")}


def summary_domain(summary: str = "summary") -> Column:
    """Domain of a DNS summary: the first word with a dot and a letter end."""
    return F.nullif(F.lower(F.regexp_extract(summary, r"([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,})", 1)), F.lit(""))


def endpoint(ip: Column, port: Column, name: Column | None = None) -> Column:
    """ip:port, IPv6 in brackets, the name in place of the address if it is known."""
    shown = F.coalesce(name if name is not None else F.lit(None).cast("string"), F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip))
    return F.when(port.isNull(), shown).otherwise(F.concat(shown, F.lit(":"), port.cast("string")))


def _any(summary: Column, texts: tuple[str, ...]) -> Column:
    return filters.any_of(*(summary.contains(t) for t in texts))


def _tokens(summary: Column, tokens: tuple[str, ...]) -> Column:
    return filters.any_of(*(has_token(summary, t) for t in tokens))


# What marks each severity, first match wins.
ERROR_TEXTS = ("Malformed", "unreachable", "connection reset", "Connection reset", "bad checksum", "Bad checksum", "checksum mismatch", "Threat detected", "Alert triggered")
WARNING_TEXTS = ("[TCP Retransmission]", "[TCP Dup ACK", "[TCP Out-of-Order]")
DNS_ERRORS = ("SERVFAIL", "NXDOMAIN", "REFUSED")
NOTE_TEXTS = ("304 Not Modified", "Connection opened", "connection opened", "Connection closing", "connection closing")


def expert_severity(summary: str = "summary") -> Column:
    s = F.col(summary)
    return (
        F.when(has_token(s, "RST") | _any(s, ERROR_TEXTS), "Error")
        .when(_any(s, WARNING_TEXTS) | _tokens(s, DNS_ERRORS), "Warning")
        .when(_any(s, NOTE_TEXTS) | _tokens(s, ("SYN", "FIN")), "Note")
        .otherwise("Chat")
    )


def severity_score(severity: Column) -> Column:
    return F.when(severity == "Error", 9).when(severity == "Warning", 6).when(severity == "Note", 3).otherwise(0)


def _findings(rows: DataFrame, rules: list[tuple[Column, dict[str, str]]]) -> DataFrame:
    """A row per rule that holds: the row's columns and the rule's texts."""
    found = F.array_compact(F.array(*(F.when(cond, F.struct(*(F.lit(v).alias(k) for k, v in texts.items()))) for cond, texts in rules)))
    return rows.select("*", F.explode(found).alias("_f")).select("*", "_f.*").drop("_f")


def diagnostics(rows: DataFrame, summary: str = "summary") -> DataFrame:
    """0..n rows per packet: severity_level, group, title."""
    s = F.col(summary)
    # Marks in summaries; severities, groups and titles of what they stand for.
    rules = [
        (_any(s, ("bad checksum", "Bad checksum", "checksum mismatch")), ("Error", "Checksum", "Corrupted Header Checksum")),
        (_any(s, ("Malformed", "truncated", "(short frame)")), ("Error", "Malformed", "Malformed Protocol Framing")),
        (s.contains("[TCP Retransmission]"), ("Warning", "Sequence", "TCP Packet Retransmission")),
        (s.contains("[TCP Dup ACK"), ("Warning", "Sequence", "TCP Duplicate Acknowledgement")),
        (s.contains("[TCP Out-of-Order]"), ("Warning", "Sequence", "TCP Out-of-Order Segment")),
        (s.contains("ZeroWindow"), ("Error", "FlowControl", "TCP Receive Window Exhaustion (Zero Window)")),
        (has_token(s, "RST") | _any(s, ("connection reset", "Connection reset")), ("Error", "ProtocolViolation", "Abrupt TCP Connection Reset (RST)")),
        (_tokens(s, DNS_ERRORS), ("Warning", "General", "DNS Resolution Error Response")),
    ]
    return _findings(rows, [(c, dict(zip(("severity_level", "diag_group", "title"), t))) for c, t in rules])


def payload_class(data: Column) -> Column:
    """empty, executable, sse, json, encrypted, compressed, text or binary, in this order."""
    text, n = F.decode(data, "ISO-8859-1"), F.length(data)
    trimmed = F.regexp_replace(text, r"^[ \t\n\r\x0c]+|[ \t\n\r\x0c]+$", "")
    printable = F.regexp_count(text, F.lit(r"[\x21-\x7e \t\n\r\x0c]"))
    wrapped = (trimmed.startswith("{") & trimmed.endswith("}")) | (trimmed.startswith("[") & trimmed.endswith("]"))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when((n >= 4) & (text.startswith("MZ") | text.startswith("\x7fELF")), "executable")
        .when(text.startswith("data: ") | text.contains("event: "), "sse")
        .when(wrapped, "json")
        .when(scalars.byte_entropy(data) > 7.4, "encrypted")
        .when(text.startswith("\x1f\x8b") | text.startswith("PK"), "compressed")
        .when(printable / n > 0.85, "text")
        .otherwise("binary")
    )


def payload_findings(rows: DataFrame, data: str = "data") -> DataFrame:
    """0..n rows per payload: finding_severity, category, title."""
    d = F.col(data)
    text = F.lower(F.decode(d, "UTF-8"))
    # Severities, categories and titles of findings.
    rules = [
        ((F.length(d) > 64) & (scalars.byte_entropy(d) > 7.7), ("medium", "entropy", "High Entropy Payload Detected")),
        ((F.length(d) >= 4) & F.hex(F.substring(d, 1, 4)).rlike("^(4D5A|7F454C46)"), ("high", "security", "Executable Binary Header In Network Payload")),
        (_any(text, ("union select", "or 1=1", "<script>")), ("high", "injection", "Suspected Web Injection Attack Payload")),
        (_any(text, ("../..", "/etc/passwd", "c:\\windows\\system32")), ("high", "injection", "Path Traversal Payload Detected")),
        (_any(text, ("password=", "api_key=", "bearer ey")), ("medium", "credentials", "Unencrypted Credential / Token In Payload")),
    ]
    return _findings(rows, [(c, dict(zip(("finding_severity", "category", "title"), t))) for c, t in rules])


def printable_strings(text: Column, least: int = 4) -> Column:
    """Runs of at least so many printable ASCII characters."""
    return F.regexp_extract_all(text, F.lit(f"([\\x20-\\x7e]{{{least},}})"), F.lit(1))


# Guesses by port, with their weight.
PORT_GUESSES = ((80, "HTTP", 40), (443, "TLS", 40), (53, "DNS", 40), (22, "SSH", 40), (445, "SMB", 40), (25, "SMTP", 40))


def guess_protocol(dport: Column, payload: Column) -> Column:
    """The protocol with the highest score from port, first bytes and entropy, or Unknown; ties go to the first by name."""
    text = F.decode(F.substring(payload, 1, 64), "ISO-8859-1")
    votes = [F.struct(F.when(dport == port, w).otherwise(0).alias("score"), F.lit(name).alias("name")) for port, name, w in PORT_GUESSES]
    votes += [
        F.struct(F.when(text.rlike(r"^([A-Z]{3,7} \S+ HTTP/|HTTP/1)"), 60).otherwise(0).alias("score"), F.lit("HTTP").alias("name")),
        F.struct(F.when(text.startswith("SSH-"), 60).otherwise(0).alias("score"), F.lit("SSH").alias("name")),
        F.struct(F.when(text.startswith("\x16\x03"), 60).otherwise(0).alias("score"), F.lit("TLS").alias("name")),
        F.struct(F.lit(1).alias("score"), F.lit("Unknown").alias("name")),
    ]
    best = F.array_sort(F.array(*votes), lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(F.when(a["name"] < b["name"], -1).otherwise(1)))
    return best[0]["name"]


def http_meaning(summary: Column) -> Column:
    """A sentence for an HTTP request or response line, else null."""
    method, uri = F.regexp_extract(summary, r"^(GET|POST|PUT|DELETE) (\S+)", 1), F.regexp_extract(summary, r"^(GET|POST|PUT|DELETE) (\S+)", 2)
    code = F.nullif(F.regexp_extract(summary, r"^HTTP/1\.[01] ([0-9]{3})", 1), F.lit("")).cast("int")
    verb = F.when(method == "GET", "reads").when(method == "POST", "sends data to").when(method == "PUT", "replaces").otherwise("removes")
    answer = F.when(code < 300, "succeeded").when(code < 400, "was redirected").when(code < 500, "was refused").otherwise("failed at the server")
    return F.when(method != "", F.concat_ws(" ", F.lit("Client"), verb, uri)).when(code.isNotNull(), F.concat(F.lit("Request "), answer, F.lit(" ("), code.cast("string"), F.lit(")")))


def row_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(field, left_value, right_value, same): two one-row frames, field by field."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    stack = lambda df, name: df.selectExpr(f"stack({len(columns)}, {pairs}) as (field, {name})")
    return stack(left, "left_value").join(stack(right, "right_value"), "field", "full").withColumn("same", F.col("left_value").eqNullSafe(F.col("right_value")))


# Technique id, name, tactic, and phases of the kill chain.
TECHNIQUES = {
    "T1046": ("Network Service Discovery", "Reconnaissance"), "T1595": ("Active Scanning", "Reconnaissance"), "T1021.002": ("SMB/Windows Admin Shares", "Lateral Movement"),
    "T1021.001": ("Remote Desktop Protocol", "Lateral Movement"), "T1021.004": ("SSH", "Lateral Movement"), "T1071.004": ("DNS Protocols", "Command and Control"),
    "T1590": ("Gather Victim Network Information", "Reconnaissance"), "T1071.001": ("Web Protocols", "Command and Control"), "T1071": ("Application Layer Protocol", "Command and Control"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"), "T1041": ("Exfiltration Over C2 Channel", "Exfiltration"),
}
PHASES = ("Reconnaissance", "Weaponization", "Delivery", "Exploitation", "Installation", "Command and Control", "Actions on Objective")


def techniques(protocol: Column, summary: Column, dport: Column, anomaly: Column) -> tuple[Column, Column]:
    """(technique ids in order of discovery, phases in order of the kill chain)."""
    p, s = F.lower(protocol), F.lower(summary)
    scan = s.contains("scan") | s.contains("discovery")
    smb = (p == "smb") | (dport == 445) | s.contains("smb") | s.contains("admin share")
    rdp = (p == "rdp") | (dport == 3389) | s.contains("rdp")
    ssh = (p == "ssh") | (dport == 22) | s.contains("ssh")
    dns = (p == "dns") | (dport == 53)
    tunnel = dns & (s.contains("tunnel") | s.contains("exfil") | anomaly)
    web = p.isin("http", "tls") | dport.isin(80, 443)
    beacon = web & (s.contains("beacon") | s.contains("c2"))
    plain_web = web & ~beacon & ~(scan | smb | rdp | ssh | dns)
    intel = s.contains("abuseipdb") | s.contains("malicious") | s.contains("urlhaus")
    exfil = s.contains("exfiltration") | s.contains("high entropy") | (anomaly & s.contains("transfer"))
    some = filters.any_of(*(filters.two_valued(c) for c in (scan, smb, rdp, ssh, dns, beacon, plain_web, intel, exfil)))
    hits = ((scan, "T1046"), (scan, "T1595"), (smb, "T1021.002"), (smb, "T1046"), (rdp, "T1021.001"), (rdp, "T1046"), (ssh, "T1021.004"), (tunnel, "T1071.004"), (dns & ~tunnel, "T1590"), (beacon, "T1071.001"), (plain_web, "T1071"), (intel, "T1190"), (exfil, "T1041"), (~some, "T1046"))
    reached = ((scan | (dns & ~tunnel) | ~some, 1), (smb, 2), (smb | intel, 3), (rdp | ssh, 4), (rdp | tunnel | beacon | plain_web, 6), (smb | exfil, 7))
    pick = lambda pairs, value: F.array_compact(F.array(*(F.when(filters.two_valued(c), F.lit(value(v))) for c, v in pairs)))
    return F.array_distinct(pick(hits, lambda v: v)), pick(reached, lambda v: PHASES[v - 1])


# Fixed values: (words in the summary, protocols, tactic, technique, phase); the first that fits decides.
FIRST_MATCH = (
    (("abuseipdb", "malicious source ip"), (), "Initial Access", "T1190", "Delivery"),
    (("urlhaus", "threat domain"), (), "Command and Control", "T1071", "Command and Control"),
    (("beacon",), (), "Command and Control", "T1071.001", "Command and Control"),
    (("malware", "payload"), (), "Execution", "T1204", "Installation"),
    (("scan",), (), "Reconnaissance", "T1595", "Recon"),
    (("query",), ("dns",), "Reconnaissance", "T1590", "Recon"),
    ((), ("ssh", "rdp"), "Lateral Movement", "T1021", "Exploitation"),
    ((), ("http", "tls"), "Command and Control", "T1071", "Command and Control"),
    (("pqc", "quantum", "classical-only"), (), "Defense Evasion", "T1573", "Command and Control"),
)


def first_technique(protocol: Column, summary: Column) -> dict[str, Column]:
    p, s = F.lower(protocol), F.lower(summary)
    out = {k: F.lit(None).cast("string") for k in ("tactic", "technique", "phase")}
    for words, protocols, *values in reversed(FIRST_MATCH):
        fits = filters.all_of(*([filters.any_of(*(s.contains(w) for w in words))] if words else []), *([p.isin(*protocols)] if protocols else []))
        out = {k: F.when(fits, v).otherwise(old) for (k, old), v in zip(out.items(), values)}
    return out


def syslog_line(host: Column, app: Column, severity: Column, message: Column, ts: Column, facility: int = 16) -> Column:
    """RFC 5424: priority, version, time, host, application, dashes for what is not known."""
    pri = (F.lit(facility * 8) + severity).cast("string")
    return F.concat(F.lit("<"), pri, F.lit(">1 "), ts, F.lit(" "), F.coalesce(host, F.lit("-")), F.lit(" "), F.coalesce(app, F.lit("-")), F.lit(" - - - "), message)


def _pairs(pairs: dict[str, Column], joint: str) -> Column:
    return F.concat_ws(joint, *(F.when(v.isNotNull(), F.concat(F.lit(k + "="), v.cast("string"))) for k, v in pairs.items()))


def cef_line(name: Column, severity: Column, extension: dict[str, Column], vendor: str = "packetloom", product: str = "engine", version: str = "1") -> Column:
    """CEF with pipes and backslashes of the header escaped; unknown extension fields are left out."""
    escaped = F.regexp_replace(name, r"([\\|])", r"\\$1")
    return F.concat(F.lit(f"CEF:0|{vendor}|{product}|{version}|100|"), escaped, F.lit("|"), severity.cast("string"), F.lit("|"), _pairs(extension, " "))


def leef_line(event: Column, attributes: dict[str, Column], vendor: str = "packetloom", product: str = "engine", version: str = "1") -> Column:
    return F.concat(F.lit(f"LEEF:2.0|{vendor}|{product}|{version}|"), event, F.lit("|"), _pairs(attributes, "\t"))


def ocsf_activity(fields: dict[str, Column]) -> Column:
    """OCSF network activity as JSON; fields that are null are left out."""
    return F.to_json(F.struct(F.lit(4001).alias("class_uid"), F.lit(4).alias("category_uid"), *(c.alias(n) for n, c in fields.items())))


def stix_indicator(kind: Column, value: Column, description: Column) -> Column:
    """STIX 2.1 indicator as JSON, its id derived from the value."""
    pattern = F.when(kind == "ip", F.concat(F.lit("[ipv4-addr:value = '"), value, F.lit("']"))).otherwise(F.concat(F.lit("[domain-name:value = '"), value, F.lit("']")))
    return F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), F.substring(F.sha2(value, 256), 1, 32)).alias("id"), pattern.alias("pattern"), description.alias("description")))


# Texts by template key; {src}, {dst} and {port} are filled in.
TEMPLATES = (("smb", "{src} reached a file share on {dst}. 1. Check the account. 2. Check shares."), ("rdp", "{src} opened a desktop session on {dst}. 1. Confirm with the user."), ("dns", "{src} looked up names at {dst}. 1. Check the domain."), ("web", "{src} talked to {dst} on port {port}. 1. Check the host."), ("other", "{src} talked to {dst}. 1. Review."))


def explanation(protocol: Column, src: Column, dst: Column, port: Column) -> Column:
    p = F.lower(protocol)
    key = F.when(p.isin("smb", "rdp", "dns"), p).when(p.isin("http", "tls"), "web").otherwise("other")
    text = F.lit(None).cast("string")
    for name, template in TEMPLATES:
        text = F.when(key == name, template).otherwise(text)
    return F.replace(F.replace(F.replace(text, F.lit("{src}"), src), F.lit("{dst}"), dst), F.lit("{port}"), port.cast("string"))


# Protocol, severity of its use, why.
PROTOCOL_RISKS = (
    ("HTTP", "medium", "Traffic is not encrypted"), ("TELNET", "high", "Credentials in the clear"), ("FTP", "high", "Credentials in the clear"), ("SMB", "medium", "Common path of lateral movement"),
    ("RDP", "high", "Common target of password guessing"), ("MODBUS", "high", "No authentication"), ("DNS", "low", "Can carry tunnels"), ("NTP", "low", "Can amplify attacks"), ("SNMP", "medium", "Community strings in the clear"),
)


def with_protocol_risk(rows: DataFrame, protocol: str = "protocol") -> DataFrame:
    risks = rows.sparkSession.createDataFrame(list(PROTOCOL_RISKS), "_p string, risk string, headline string")
    return rows.join(F.broadcast(risks), F.upper(protocol) == F.col("_p"), "left").drop("_p")  # a table of fixed size
