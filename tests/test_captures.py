"""Capture formats and the reader's batches."""

import os
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from packetloom.sources import captures

ERF = bytes(8) + struct.pack(">BBHHH", 2, 4, 64, 0, 48) + bytes(48)
HEADS = [
    (b"\xd4\xc3\xb2\xa1", "pcap"), (b"\xa1\xb2\x3c\x4d", "pcap"), (b"\x34\xcd\xb2\xa1", "modified pcap"), (b"\x0a\x0d\x0d\x0a", "pcapng"), (b"snoop\0\0\0", "snoop"),
    (b"GMBU", "netmon"), (b"trnsfile\0", "sniffer"), (b"+---------+----\r\n12:00,ETHER\r\n", "k12"), (b"title\n|0   |ff|", "k12"), (b"plain text, longer than sixteen bytes", "unknown"),
    (ERF, "erf"), (ERF[:15], "unknown"), (bytes(8) + b"\x07" + ERF[9:], "unknown"), (b"", "unknown"), (None, "unknown"),
]


def test_formats(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADS)], "i int, content binary")
    got = {r.i: r.f for r in frame.select("i", captures.capture_format(F.col("content")).alias("f")).collect()}
    assert [got[i] for i in range(len(HEADS))] == [name for _, name in HEADS]


def test_frames_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(captures, "BATCH_FRAMES", 7)
    head = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1)
    raw = head + b"".join(struct.pack("<IIII", i, i, 2, 60) + struct.pack("<H", i) for i in range(5000))
    files = spark.createDataFrame([("a", raw, 1), ("b", head, 2), (None, None, 3), ("c", b"", 4)], "path string, content binary, data int")
    rows = captures.decode_captures(files).orderBy("idx").collect()
    assert [(r.path, r.idx, r.ts_sec, r.ts_nanos, r.orig_len, r.link_type, bytes(r.data)) for r in rows] == [("a", i, i, i * 1000, 60, 1, struct.pack("<H", i)) for i in range(5000)]


def test_other_formats_are_an_error(spark):
    with pytest.raises(Exception, match="not a capture file"):
        captures.decode_captures(spark.createDataFrame([("a", b"PK\3\4")], "path string, content binary")).collect()


def pcap(rows, order="<", magic=b"\xd4\xc3\xb2\xa1"):
    head = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 262144, 1)
    return head + b"".join(struct.pack(order + "IIII", sec, frac, len(data), len(data) + 3) + data for sec, frac, data in rows)


def pcapng(rows, order, resolutions):
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    for k, ticks in enumerate(resolutions):
        out += block(1, struct.pack(order + "HHI", k + 1, 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, ticks, 0, 0))
        part = rows[k :: len(resolutions)]
        out += b"".join(block(6, struct.pack(order + "IIIII", k, (sec * 10**ticks) >> 32, (sec * 10**ticks) & 0xFFFFFFFF, len(d), len(d)) + d + b"\0" * (-len(d) % 4)) for sec, _, d in part)
    return out


@pytest.mark.parametrize("size", [1 << 20, 4096, 900])
def test_ranges_of_any_size_give_the_same_frames(spark, size):
    rng = random.Random(4)
    rows = [(1_700_000_000 + i, i, rng.randbytes(rng.choice([1, 20, 60, 900]))) for i in range(150)]
    zeros = [(1_700_000_000 + i, i, bytes(500)) for i in range(40)]
    inside = pcap([(1_700_000_000 + i, i, b"inner" * 9) for i in range(30)])  # ends where the packet that holds it ends
    nested = [(1_700_000_100, 1, b"x" * 30), (1_700_000_101, 2, inside), (1_700_000_102, 3, b"y" * 2000), (1_700_000_103, 4, inside)] * 3
    files = {
        "a": pcap(rows), "b": pcap(rows, ">", b"\xa1\xb2\xc3\xd4"), "c": pcap(rows, "<", b"\x4d\x3c\xb2\xa1")[:-5], "d": pcap(zeros), "e": pcap(nested), "f": pcap([]), "g": b"",
        "h": pcapng(rows, "<", [6, 9, 3]), "i": pcapng(rows[:40], "<", [6]) + pcapng(rows[40:], ">", [9, 6]),
    }
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    captures.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"), folder)
    got = sorted((r.path[-1], r.idx, r.ts_sec, r.ts_nanos, r.orig_len, r.link_type, bytes(r.data)) for r in captures.read_captures(spark, folder, size).collect())
    assert got == sorted((k, i, *f) for k, v in files.items() if v for i, f in enumerate(captures.frames_of(v)))


def test_a_large_file_is_read_by_many_tasks(spark):
    """A file with holes, of 3 GB in a full run: more than a value of Spark may have."""
    n = 12_000 if os.environ.get("ALL_QUERIES") else 400
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/large", "wb") as out:
        out.write(pcap([]))
        for i in range(n):
            out.write(struct.pack("<IIII", 1_700_000_000 + i, 0, 1 << 18, 1 << 18))
            out.seek(1 << 18, 1)
        out.truncate(24 + n * (16 + (1 << 18)))
    frames = captures.read_captures(spark, folder, 16 << 20)
    out = frames.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min("idx"), F.sum("idx").alias("s")).collect()
    assert len(out) > 2 and sum(r.n for r in out) == n and sum(r.s for r in out) == n * (n - 1) // 2


def test_small_ranges_share_tasks(spark):
    from packetloom.sources import ranges

    def tasks(n, size):
        return ranges._tasks(spark.range(n).selectExpr("0L as first", f"{size}L as stop"))

    assert tasks(50_000, 12_000) <= 64 and tasks(500_000, 12_000) <= 600  # of 600 MB and 6 GB
    assert tasks(3, 10) == 3 and tasks(500, 64 << 20) == 500 and tasks(0, 1) == 1
