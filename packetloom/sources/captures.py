"""Capture files as tables: classic pcap (micro- and nanoseconds, both byte orders) and pcapng; format census."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, idx long, ts_sec long, ts_nanos int, orig_len long, link_type int, data binary"

# First bytes of capture formats, in hex.
FORMATS = (
    ("sniffer", "74726E7366696C6500"),
    ("snoop", "736E6F6F70000000"),
    ("pcap", "A1B2C3D4"), ("pcap", "D4C3B2A1"), ("pcap", "A1B23C4D"), ("pcap", "4D3CB2A1"),
    ("modified pcap", "A1B2CD34"), ("modified pcap", "34CDB2A1"),
    ("pcapng", "0A0D0D0A"),
    ("netmon", "474D4255"),
)
# Record types of Ethernet frames that a file without header may begin with; how lines of text exports begin.
ERF_TYPES = (2, 4, 5)
K12_LINES = r"(?:^|\n)(?:\+---|\|0 {2,3}\|)"
#: Frames and bytes of them that go out in one batch.
BATCH_FRAMES, BATCH_BYTES = 4096, 8 << 20
#: Bytes of blocks that are decoded at once.
MANY = 8 << 20


def pcap_order(head: bytes) -> tuple[str, int]:
    """Byte order and nanoseconds of a tick of a capture file by its first bytes; a pcapng file (its blocks say both) has 0 ticks."""
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        return "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", 0
    order = {b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">", b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<"}.get(head[:4])
    if order is None:
        raise ValueError("not a capture file that can be read")
    return order, 1 if head[:4] in (b"\xa1\xb2\x3c\x4d", b"\x4d\x3c\xb2\xa1") else 1000


def frames_of(raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(seconds, nanoseconds, original length, link type, bytes) of each record; a cut last record is left out."""
    order, unit = pcap_order(raw)
    if not unit:
        yield from Section().read(raw)
        return
    link = struct.unpack(order + "I", raw[20:24])[0]
    at = 24
    while at + 16 <= len(raw):
        sec, frac, kept, length = struct.unpack(order + "IIII", raw[at : at + 16])
        if at + 16 + kept > len(raw):
            return
        yield sec, frac * unit, length, link, raw[at + 16 : at + 16 + kept]
        at += 16 + kept


class Section:
    """What blocks of a pcapng file say about those that follow: byte order, and link type and ticks a second of each interface."""

    def __init__(self) -> None:
        self.order, self.interfaces = "<", list[tuple[int, int]]()

    def read(self, raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Frames of whole blocks; those that describe are taken in even if no frame is asked for."""
        return iter(list(self._frames(raw))) if len(raw) < MANY else self._frames(raw)

    def _frames(self, raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
        at = 0
        while at + 12 <= len(raw):
            if raw[at : at + 4] == b"\x0a\x0d\x0d\x0a":
                self.order = "<" if raw[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                self.interfaces = []
            kind, size = struct.unpack(self.order + "II", raw[at : at + 8])
            if size < 12 or at + size > len(raw):
                return
            body = raw[at + 8 : at + size - 4]
            if kind == 1:
                self.interfaces.append(self._interface(body))
            elif kind == 6 and len(body) >= 20:
                number, high, low, kept, length = struct.unpack(self.order + "IIIII", body[:20])
                link, ticks = self.interfaces[number] if number < len(self.interfaces) else (1, 1_000_000)
                stamp = high << 32 | low
                yield stamp // ticks, stamp % ticks * 1_000_000_000 // ticks, length, link, body[20 : 20 + kept]
            at += size

    def _interface(self, body: bytes) -> tuple[int, int]:
        ticks, option = 1_000_000, 8
        while option + 4 <= len(body):
            code, n = struct.unpack(self.order + "HH", body[option : option + 4])
            if code == 9 and n == 1:
                value = body[option + 4]
                ticks = 2 ** (value & 127) if value & 128 else 10**value
            if code == 0:
                break
            option += 4 + n + (-n) % 4
        return struct.unpack(self.order + "H", body[:2])[0], ticks


def read_captures(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Raw frames of all capture files under a path, which Spark lists. Files in a store that tasks can open are read in byte ranges, so that
    a capture of any size is read by many tasks; elsewhere Spark's own reader opens them, a file a task and 2 GB at most."""
    from . import ranges

    files = spark.read.format("binaryFile").load(path)
    listed = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("size"))
    stores = {r[0] for r in listed.select(F.regexp_extract("path", "^([a-z0-9]+):", 1)).distinct().collect()}
    if stores <= set(ranges.STORES):
        return ranges.read_ranges(spark, listed, range_bytes or ranges.RANGE_BYTES)
    return decode_captures(files.select("path", "content"))


def decode_captures(files: DataFrame) -> DataFrame:
    """(path, content) -> raw frames, each file by one task, files spread over tasks. Records are walked in place and go out in small batches,
    so that a task holds one file and a few thousand frames. A null or empty content has no frames; one of another format is an error."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("ts_sec", pa.int64()), ("ts_nanos", pa.int32()), ("orig_len", pa.int64()), ("link_type", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                name, raw = name.as_py(), content.as_py()
                rows, held = [], 0
                for idx, frame in enumerate(frames_of(raw) if raw else ()):
                    rows.append((name, idx, *frame))
                    held += len(frame[-1])
                    if len(rows) == BATCH_FRAMES or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def capture_format(content: Column) -> Column:
    """Name of the capture format by the first 64 bytes, else unknown: magic numbers first, then text exports (printable, with a line of
    dashes or of bytes), then a first record without a file header that has a known type, a length of at least its header and a frame."""
    head = F.substring(content, 1, 64)
    hexed = F.hex(head)
    number = lambda at, n: F.conv(F.substring(hexed, 2 * at + 1, 2 * n), 16, 10).cast("int")
    printable = hexed.rlike("^(?:0[9AD]|[2-6][0-9A-F]|7[0-9A-E])*$")
    bare = (F.length(head) >= 16) & number(8, 1).bitwiseAND(127).isin(*ERF_TYPES) & (number(10, 2) >= 16) & (number(14, 2) > 0)
    text = F.when(printable & F.decode(F.when(printable, head), "ISO-8859-1").rlike(K12_LINES), "k12")
    out = text.when(bare, "erf").otherwise("unknown")
    for name, magic in reversed(FORMATS):
        out = F.when(hexed.startswith(magic), name).otherwise(out)
    return out


def capture_census(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", capture_format(F.col("content")).alias("format"))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes each (path, content) as a file of that name, slashes as dashes, into a folder of a store that tasks can open. Each file is written
    beside its place and moved there, so that a task that runs again leaves the same files."""
    at = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def write(batches: Iterator) -> Iterator:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(at)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                beside = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content.as_py())
                store.move(beside, f"{base}/{name.replace('/', '-')}")
            yield batch.select([0])

    files.select("path", "content").mapInArrow(write, "path string").agg(F.count("*")).collect()
