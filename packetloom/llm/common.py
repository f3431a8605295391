"""Helpers that the text operators share: shared-folder tables, word splitting, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that ends a word: space and the bytes 0x09 to 0x0D. bytes.split() splits at exactly these.
WHITE = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach. Where it is unset, a local run
    (tests) sets a temporary one and a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            path = jvm_dir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        else:
            path = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: cuts the lineage so that a lost executor costs
    only the tasks that read it. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packetloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def long_values(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most from here on in this session: texts are long, and a batch is held in the JVM and in the
    Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Known:
    """What a Python worker knows of short byte strings: for each a value, and a number. Holds `limit` of them and `size` bytes at most;
    when it is full, those that were used longest ago go. Strings longer than `longest` are never held. learn gives (values, numbers) of
    strings that are new."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[list[bytes], np.ndarray]], limit: int, size: int = 32 << 20, longest: int = 256):
        self.learn, self.limit, self.size, self.longest, self.clock = learn, limit, size, longest, 0
        self.keys = self.values = pa.array([], pa.large_binary())
        self.numbers, self.used = np.zeros(0), np.zeros(0, np.int64)

    def of(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Values and numbers of distinct keys."""
        short = pc.less_equal(pc.binary_length(keys), self.longest).to_numpy(zero_copy_only=False)
        if short.all():
            at = self._places(keys)
            return self.values.take(pa.array(at)), self.numbers[at]
        at = self._places(keys.filter(pa.array(short)))
        values, numbers = self.learn(slices(keys.filter(pa.array(~short))))
        order = np.empty(len(keys), np.int64)
        order[np.concatenate((np.flatnonzero(short), np.flatnonzero(~short)))] = np.arange(len(keys))
        both = pa.concat_arrays([self.values.take(pa.array(at)), pa.array(values, pa.large_binary())])
        return both.take(pa.array(order)), np.concatenate((self.numbers[at], numbers))[order]

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Where in values and numbers the distinct keys are, until the next call."""
        place = pc.index_in(keys, self.keys)
        if place.null_count and (len(self.keys) + place.null_count > self.limit or self.keys.nbytes + self.values.nbytes > self.size):
            half = max(1, min(self.limit, len(self.keys)) // 2)
            kept = np.sort(np.argsort(self.used, kind="stable")[-half:])
            self.keys, self.values = self.keys.take(pa.array(kept)), self.values.take(pa.array(kept))
            self.numbers, self.used = self.numbers[kept], self.used[kept]
            place = pc.index_in(keys, self.keys)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if place.null_count:
            at[new] = len(self.keys) + np.arange(place.null_count)
            missing = keys.filter(pa.array(new))
            values, numbers = self.learn(slices(missing))
            self.keys = pa.concat_arrays([self.keys, missing])
            self.values = pa.concat_arrays([self.values, pa.array(values, pa.large_binary())])
            self.numbers, self.used = np.concatenate((self.numbers, numbers)), np.concatenate((self.used, np.zeros(len(values), np.int64)))
        self.clock += 1
        self.used[at] = self.clock
        return at


def slices(values: pa.Array) -> list[bytes]:
    """The values of a large binary array that begins where its buffers do, without nulls."""
    if not len(values):
        return []
    data, offsets = values.buffers()[2].to_pybytes(), np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1].tolist()
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def flat(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a large binary array without nulls, and where each value begins, with the end."""
    values = pa.concat_arrays([texts])  # from offset 0
    offsets = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    raw = values.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    return raw, offsets - offsets[0]


def cut(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Bytes as large binary values, cut where begins says (an end follows by itself)."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data)])


def by_bytes(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Stretches of a text column, nulls as empty, of about so many bytes (one text at least)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: what decides which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


#: Rows of a range of an order, about.
RANGE_ROWS = 1 << 20


def preceding(rows: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str, row: str | None = None) -> DataFrame:
    """Adds `name`: the sum of amount over the rows with the same keys that come before in the order, nulls first unless order says
    otherwise; equal rows come in any order. With row also a number of its own for each row, rising in the order of keys.

    The order is dealt in ranges and each range is summed by itself, so that neither a key nor a run of equal rows meets in one task."""
    spark = rows.sparkSession
    parts = max(shuffle_partitions(spark), -(-rows.count() // RANGE_ROWS))
    tie, number, part, start = (unused(rows, n) for n in ("tie", "number", "part", "start"))
    by = [*map(F.col, keys), *order, F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(tie)
    placed = materialise(dealt.withColumn(number, F.monotonically_increasing_id()), "ordered").withColumn(part, F.shiftright(number, 33))
    sums = placed.groupBy(part, *keys).agg(F.sum(amount).alias(start))
    starts = sums.withColumn(start, F.sum(start).over(Window.partitionBy(*keys).orderBy(part)) - F.col(start))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(part, *keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col(f"a.{part}") == F.col(f"b.{part}")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = placed.withColumn(name, inside).alias("a").join(starts.alias("b"), same)
    out = [*(F.col(f"a.`{c}`") for c in rows.columns if c != name), (F.col(f"a.{name}") + F.col(f"b.{start}")).alias(name)]
    return both.select(*out, *([F.col(f"a.{number}").alias(row)] if row else []))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, component): component is the smallest node that is reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every step is a grouped minimum and a join on the
    node, never holds a component in one task, and the number of edges never grows. Stops when a round changes nothing.
    Nulls and loops are ignored; nodes without an edge do not appear.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    current, before = materialise(pairs, "edges"), None
    for _ in range(max_rounds):
        now = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == before:
            break
        before = now
        if not now[0]:
            break
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        current = materialise(linked.union(small.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    ).distinct()
