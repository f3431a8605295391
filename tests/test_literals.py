"""Small literal cases with known answers."""

import struct

import pytest
from pyspark.sql import functions as F

from packetloom.functions import scalars
from packetloom.operators import baseline, blocks, detect, filters, flows, folds, governance, handshakes
from packetloom.plans import catalog
from packetloom.sources import adapters, captures

from .conftest import DATA


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


def packets(spark, rows):
    return spark.createDataFrame(rows, "seq long, us long, src string, sport int, dst string, dport int, protocol string, length long, summary string")


def test_entropy(spark):
    assert one(spark, scalars.byte_entropy(F.col("v")), bytearray(100), "binary") == 0
    assert one(spark, scalars.byte_entropy(F.col("v")), bytearray(range(256)), "binary") == pytest.approx(8)
    assert one(spark, scalars.char_entropy(F.col("v")), "") == 0


def test_human_bytes(spark):
    for n, text in ((500, "500 B"), (145 * 1024, "145.0 KB"), (2300 * 1024, "2.2 MB")):
        assert one(spark, scalars.human_bytes(F.col("v")), n, "long") == text


def test_scope_and_duration(spark):
    for ip, scope in (("127.0.0.1", "loopback"), ("172.31.9.9", "private"), ("172.32.0.1", "public"), ("fe80::1", "link-local"), (None, None)):
        assert one(spark, scalars.address_scope(F.col("v")), ip) == scope
    for text, seconds in (("30s", 30), ("5m", 300), ("1h", 3600), ("soon", 30)):
        assert one(spark, scalars.duration_seconds(F.col("v")), text) == seconds


def test_scope_reads_its_address_once(spark):
    """A filter takes the place of a column's expression: the number in props is read a few times a row, not some times for each network."""
    sent = catalog.QUERIES["det09_outbound_volume"](spark, DATA)
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") < 20
    for ip, scope in (("1.2.3", "public"), ("", "public"), ("10.0.0.256", "private"), ("999.1.1.1", "public"), ("2001:db8::1", "public"), ("::1", "loopback"), ("FD00::1", "private")):
        assert one(spark, scalars.address_scope(F.col("v")), ip) == scope
    assert one(spark, scalars.in_network(F.col("v"), "10.1.0.0/16"), None) is False and one(spark, scalars.in_network(F.col("v"), "10.1.0.0/16"), "10.1.255.255") is True


def test_negation_of_a_missing_field_is_true(spark):
    row = packets(spark, [(1, 0, "10.0.0.1", None, "10.0.0.2", None, "ICMP", 60, "ping")])
    assert row.where(~filters.either_port("eq", 80, "tcp")).count() == 1
    assert row.where(filters.either_port("ne", 80)).count() == 0


def test_unknown_hunt_field_is_refused():
    with pytest.raises(ValueError):
        filters.hunt({"field": "nope", "cmp": "eq", "value": 1})


def test_flow_table(spark):
    s = 1_000_000
    two = packets(spark, [(1, 0, "10.0.0.1", 12345, "10.0.0.2", 80, "TCP", 60, "a"), (2, s, "10.0.0.2", 80, "10.0.0.1", 12345, "TCP", 120, "b")])
    flow = flows.with_duration(flows.flow_table(two)).collect()
    assert len(flow) == 1
    f = flow[0]
    assert (f.packets, f.bytes, f.sent_packets, f.received_packets, f.client, f.duration_us) == (2, 180, 1, 1, "10.0.0.1:12345", s)
    ports = packets(spark, [(1, 0, "10.0.0.1", 1111, "10.0.0.2", 80, "TCP", 1, "a"), (2, 1, "10.0.0.1", 2222, "10.0.0.2", 80, "TCP", 1, "a")])
    assert flows.flow_table(ports).count() == 2
    kinds = packets(spark, [(1, 0, "10.0.0.1", 1, "10.0.0.2", 2, "TCP", 1, "a"), (2, 1, "10.0.0.1", 1, "10.0.0.2", 2, "DNS", 1, "a")])
    assert flows.flow_table(kinds).count() == 2
    up = packets(spark, [(i, i, "10.0.0.1", 1, "10.0.0.2", 2, p, 1, "a") for i, p in enumerate(("TCP", "HTTP", "TCP"))])
    assert flows.flow_table(up).first().protocol == "HTTP"
    assert flows.flow_table(two.where("false")).count() == 0


def test_tcp_tags(spark):
    rows = [(1, "f", 1000, 100, 0, 9), (2, "f", 1000, 100, 0, 9), (3, "f", 500, 100, 0, 9), (4, "f", 1100, 0, 7, 9), (5, "f", 1100, 0, 7, 9)]
    frame = spark.createDataFrame(rows, "seq long, flow string, tcp_seq long, payload_len int, ack long, win int")
    tags = [r.tag for r in flows.tcp_tags(frame, ["flow"]).orderBy("seq").collect()]
    assert tags == [None, "Retransmission", "Out-of-Order", None, "Dup ACK #1"]


def test_service_calls(spark):
    rows = [("f", True, True, False, 0, 1000, 1), ("f", False, True, True, 0, 1012, 2), ("f", True, False, True, 10, 1020, 3), ("f", False, False, True, 0, 1022, 4), ("f", False, False, True, 10, 1120, 5)]
    frame = spark.createDataFrame(rows, "flow_id string, from_client boolean, syn boolean, ack boolean, payload_len int, ms long, seq long").withColumns({"server": F.lit("s"), "client": F.lit("c")})
    r = flows.service_calls(frame).first()
    assert (r.calls, r.median_ms, r.network_ms) == (1, 100, 12)


def test_ewma_and_z(spark):
    frame = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0)], "seq long, key string, x double")
    assert [r.ewma for r in blocks.ewma(frame, "key", "x", 0.5, ["seq"]).orderBy("seq").collect()] == [10, 15]
    assert baseline.running_z(frame, ["key"], "x", ["seq"]).orderBy("seq").first().z == 0


def test_cooldown_is_greedy(spark):
    s = 1_000_000
    frame = spark.createDataFrame([(i, "a", t * s) for i, t in enumerate((0, 6, 10, 16, 20))], "seq long, key string, us long")
    assert [r.seq for r in folds.cooldown(frame, ["key"], 10).orderBy("seq").collect()] == [0, 2, 4]


def test_capture_beacons(spark):
    even = [(i, i * 5_000_000, "a", 1, "b", 2, "TCP", 1, "") for i in range(8)]
    odd = [(10 + i, i * i * 7_000_000, "a", 1, "c", 2, "TCP", 1, "") for i in range(8)]
    found = detect.capture_beacons(packets(spark, even + odd)).collect()
    assert [(r.dst, r.interval) for r in found] == [("b", 5.0)]


def test_fingerprints(spark):
    frame = spark.createDataFrame([([0x0A0A, 0x002F], [0, 10, 11, 13, 16, 43], [29], [0], [0x0403, 0x0804], [0x0304, 0x0303], ["h2"], "github.com")], "c array<int>, e array<int>, g array<int>, f array<int>, s array<int>, v array<int>, a array<string>, sni string")
    r = frame.select(handshakes.ja3_text(F.lit(771), F.col("c"), F.col("e"), F.col("g"), F.col("f")).alias("ja3"), handshakes.ja4(F.lit(771), *(F.col(x) for x in ("c", "e", "s", "v", "a", "sni"))).alias("ja4"), F.substring(F.sha2(F.lit("002f"), 256), 1, 12).alias("b"), F.substring(F.sha2(F.lit("000a,000b,000d,002b_0403,0804"), 256), 1, 12).alias("c12")).first()
    assert r.ja3 == "771,47,0-10-11-13-16-43,29,0"
    assert r.ja4 == f"t13d0106h2_{r.b}_{r.c12}"


def test_anonymise(spark):
    assert one(spark, governance.anonymise_ip(F.col("v")), "192.168.1.55") == "192.168.1.0"
    assert one(spark, governance.anonymise_ip(F.col("v")), "2001:db8:85a3:8d3:1:2:3:4") == "2001:db8:85a3::"


def test_audit_chain(spark):
    rows = [(1, "0" * 64, "u", "a", "r", "ip", 5), (2, "x", "u", "a", "r", "ip", 6)]
    frame = spark.createDataFrame(rows, "id long, prev_hash string, user_id string, action string, resource string, ip_address string, timestamp_epoch long")
    hashed = frame.withColumn("entry_hash", governance.entry_hash())
    assert [r.id for r in governance.verify_chain(hashed).collect()] == [2]


@pytest.mark.parametrize(("magic", "order", "unit"), [(b"\xd4\xc3\xb2\xa1", "<", 1000), (b"\xa1\xb2\xc3\xd4", ">", 1000), (b"\x4d\x3c\xb2\xa1", "<", 1)])
def test_capture_reader(spark, tmp_path, magic, order, unit):
    raw = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1) + struct.pack(order + "IIII", 7, 5, 3, 9) + b"abc" + struct.pack(order + "IIII", 8, 6, 50, 50) + b"cut"
    (tmp_path / "x.pcap").write_bytes(raw)
    rows = captures.read_captures(spark, str(tmp_path)).collect()
    assert [(r.idx, r.ts_sec, r.ts_nanos, r.orig_len, bytes(r.data)) for r in rows] == [(0, 7, 5 * unit, 9, b"abc")]
    assert captures.capture_census(spark, str(tmp_path)).first().format.startswith("pcap")


def test_pcapng_reader():
    def block(kind, body):
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    nanos = struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)
    stamp = 3_000_000_007
    raw = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, nanos) + block(6, struct.pack("<IIIII", 0, stamp >> 32, stamp & 0xFFFFFFFF, 2, 2) + b"hi\0\0")
    assert list(captures.frames_of(raw)) == [(3, 7, 2, 1, b"hi")]


def test_flow_conservation(spark):
    from packetloom.sources.adapters import packets as table

    from .conftest import DATA

    p = table(spark, DATA)
    total = flows.flow_table(p).agg(F.sum("packets").alias("n"), F.sum("bytes").alias("b")).first()
    assert (total.n, total.b) == tuple(p.agg(F.count("*"), F.sum("length")).first())


def test_services_of_rows_without_a_number(spark, tmp_path):
    rows = [(0, None), (1, "{}"), (2, "x"), (3, '{"k": -3}'), (4, '{"k": 90}'), (5, '{"k": 17}')]
    events = spark.createDataFrame(rows, "event_id long, props string").selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "1L as user_id", "'click' as event_type", "1.0D as value", "props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = {r.seq: (r.protocol, r.dport) for r in adapters.packets(spark, str(tmp_path)).collect()}
    assert found == {0: ("TCP", 25), 1: ("TCP", 25), 2: ("TCP", 25), 3: ("TCP", 25), 4: ("HTTP", 80), 5: ("NTP", 123)}


def test_a_pushed_filter_reads_the_number_once(spark):
    plan = adapters.packets(spark, "/root/testdata/sf0.001").where("protocol = 'TLS'").select("seq")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1
