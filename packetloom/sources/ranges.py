"""Capture files in byte ranges: one file of any size is read by many tasks.

A range does not know where its first record begins. A first pass finds for each range the first place from which a chain of plausible record
headers leads on, walks from there to the end of the range and says where the next record begins. Since the walk of the first range is sure,
these ends prove the starts of the ranges that follow, one after the other. A file in which they do not meet (a capture inside a packet, say)
is walked once from its start by one task, which hops from header to header. The second pass decodes each range from its proven start."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .captures import BATCH_BYTES, BATCH_FRAMES, SCHEMA, Section, pcap_order
from .scratch import settled

RANGE_BYTES = 64 << 20
#: Tasks that ranges are dealt to at least, if there are so many; bytes and ranges that a task takes.
LEAST_TASKS, TASK_BYTES, TASK_RANGES = 64, 16 << 20, 1000
#: Bytes of a file that a task holds.
STRETCH = 1 << 20
#: Records that have to follow a place to make it plausible; bytes a record has at most for that; how far its time may be from the first one's.
CHAIN, MOST, YEARS = 8, 1 << 18, 20 * 366 * 86400
# Kinds of pcapng blocks that are looked for, and the kind that begins a section.
BLOCKS, SECTION = (1, 2, 3, 4, 5, 6), 0x0A0D0D0A
#: Stores that tasks open by themselves; what lies elsewhere is read through Spark, a file a task.
STORES = ("file", "hdfs", "s3", "gs")


class Ranged:
    """Bytes of a file by place; holds one stretch at a time."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, STRETCH), at)
        return self.held[at - self.at : at - self.at + n]


class Records:
    """The records of a pcap or the blocks of a pcapng file, from any place where one begins."""

    def __init__(self, file: Ranged):
        self.file, head = file, file.get(0, 40)
        self.order, self.unit = pcap_order(head)
        self.ng = self.unit == 0
        self.first = 0 if self.ng else 24
        if not self.ng:
            self.link, self.began = struct.unpack(self.order + "I", head[20:24])[0], struct.unpack(self.order + "I", head[24:28])[0] if len(head) >= 28 else 0

    def after(self, at: int) -> int | None:
        """Where the record that begins here ends; None at the end of the file or of what is whole of it."""
        head = self.file.get(at, 16)
        if self.ng:
            if len(head) < 12:
                return None
            if head[:4] == b"\x0a\x0d\x0d\x0a":
                self.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(self.order + "I", head[4:8])[0]
            return at + size if size >= 12 and at + size <= self.file.size else None
        if len(head) < 16:
            return None
        to = at + 16 + struct.unpack(self.order + "I", head[8:12])[0]
        return to if to <= self.file.size else None

    def plausible(self, at: int) -> bool:
        head = self.file.get(at, 16)
        if self.ng:
            if len(head) < 12:
                return False
            kind, size = struct.unpack(self.order + "II", head[:8])
            return (kind in BLOCKS or kind == SECTION) and 12 <= size <= MOST and size % 4 == 0 and self.file.get(at + size - 4, 4) == head[4:8]
        if len(head) < 16:
            return False
        sec, frac, kept, length = struct.unpack(self.order + "IIII", head)
        return frac < (1_000_000_000 if self.unit == 1 else 1_000_000) and 0 < kept <= MOST and kept <= length and abs(sec - self.began) < YEARS

    def find(self, start: int, stop: int) -> int | None:
        """The first place in the range from which plausible records follow each other."""
        for at in range(start, stop):
            if self.plausible(at):
                to, steps = at, 0
                while to is not None and steps < CHAIN and self.plausible(to):
                    to, steps = self.after(to), steps + 1
                if to is None or steps == CHAIN or to >= self.file.size:
                    return at
        return None

    def heads(self, at: int, to: int) -> bytes:
        """The block itself if it describes a section or an interface."""
        if not self.ng or self.file.get(at, 4) not in (b"\x0a\x0d\x0d\x0a", struct.pack(self.order + "I", 1)):
            return b""
        return self.file.get(at, to - at)

    def walk(self, at: int, stop: int) -> tuple[int, int, bytes]:
        """(where the first record beyond the range begins, records, descriptions) from a place where a record begins."""
        records, heads = 0, b""
        while at < stop:
            to = self.after(at)
            if to is None:
                return self.file.size, records, heads
            if self.ng:
                heads += self.heads(at, to)
                records += struct.unpack(self.order + "I", self.file.get(at, 4))[0] == 6 and to - at >= 32
            else:
                records += 1
            at = to
        return at, records, heads


INDEX = "path string, size long, number long, start long, stop long, first long, next long, records long, heads binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            records = Records(Ranged(row["path"]))
            first = records.first if not row["number"] else records.find(row["start"], row["stop"])
            to, n, heads = records.walk(first, row["stop"]) if first is not None else (None, 0, b"")
            out.append(row | {"first": first, "next": to, "records": n, "heads": heads})
        yield pa.RecordBatch.from_pylist(out, _schema(INDEX))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All ranges of whole files, each from where the one before ends."""
    for batch in batches:
        for row in batch.to_pylist():
            records = Records(Ranged(row["path"]))
            at, width = records.first, row["stop"]
            for number, start in enumerate(range(0, row["size"], width)):
                stop, first = min(row["size"], start + width), at if at < start + width else None
                at, n, heads = records.walk(at, stop) if first is not None else (at, 0, b"")
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "size": row["size"], "number": number, "start": start, "stop": stop, "first": first, "next": at, "records": n, "heads": heads}], _schema(INDEX))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def capture_ranges(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files: (path, size). The ranges in which a record begins: (path, first, stop, before, heads), before being the records of the ranges
    before and heads the descriptions of sections and interfaces that stand before it. Empty files have none."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {range_bytes}")))
    ranges = files.where("size > 0").select("path", "size", numbers.alias("number"))
    ranges = ranges.withColumns({"start": F.col("number") * range_bytes, "stop": F.least("size", (F.col("number") + 1) * range_bytes)})
    found = settled(ranges.repartition(_tasks(ranges, "start"), "path", "number").mapInArrow(_index, INDEX), "index")
    in_file = Window.partitionBy("path").orderBy("number")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.max("next").over(earlier), F.col("first"))
    meets = F.coalesce(F.col("first") == expected, F.lit(False)) | (F.col("first").isNull() & (expected >= F.col("stop")))
    marked = found.withColumn("meets", F.min(meets).over(Window.partitionBy("path")))
    lost = marked.where("not meets").groupBy("path", "size").agg(F.lit(range_bytes).cast("long").alias("stop"))
    proven = marked.where("meets").drop("meets").unionByName(lost.mapInArrow(_walked, INDEX))
    before = F.coalesce(F.sum("records").over(earlier), F.lit(0))
    heads = F.array_join(F.collect_list(F.hex("heads")).over(earlier), "")  # a few small blocks a file
    return proven.withColumns({"before": before, "heads": F.unhex(heads)}).where("first is not null").select("path", "first", "stop", "before", "heads")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(SCHEMA)
    for batch in batches:
        for row in batch.to_pylist():
            file = Ranged(row["path"])
            records, section = Records(file), Section()
            section.read(row["heads"])
            records.order = section.order if records.ng else records.order
            at, number, rows, held = row["first"], row["before"], [], 0
            while at < row["stop"]:
                to = records.after(at)
                if to is None:
                    break
                if records.ng:
                    frames = section.read(file.get(at, to - at))
                else:
                    sec, frac, kept, length = struct.unpack(records.order + "IIII", file.get(at, 16))
                    frames = [(sec, frac * records.unit, length, records.link, file.get(at + 16, kept))]
                for frame in frames:
                    rows.append((row["path"], number, *frame))
                    number, held = number + 1, held + len(frame[-1])
                if len(rows) >= BATCH_FRAMES or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
                at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_ranges(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raw frames of capture files (path, size), each file by as many tasks as it has ranges; the rows are the same for any range size."""
    ranges = settled(capture_ranges(spark, files, range_bytes), "ranges")
    return ranges.repartition(_tasks(ranges), "path", "first").mapInArrow(_decode, SCHEMA)


def _tasks(ranges: DataFrame, first: str = "first") -> int:
    """Tasks by the bytes of ranges and by their number, as many as ranges where there are few; many small ranges share a task, since a task
    costs more than such a range."""
    n, size = ranges.agg(F.count("*"), F.sum(F.col("stop") - F.col(first))).first()
    return max(1, min(n, max(LEAST_TASKS, -(-(size or 0) // TASK_BYTES), -(-n // TASK_RANGES))))
