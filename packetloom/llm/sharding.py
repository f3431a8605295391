"""Minimax contiguous partition: atomic groups, in a fixed order, are cut into shards whose largest one is as small as it can be.

The smallest capacity is found by binary search, each capacity checked by filling shards greedily. No task and no driver
ever holds all groups: the search runs over a histogram of the order (a bounded number of cells with their sums) and
only cells that a cut may fall into are split further, until the bounds meet. Everything is DataFrame work.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table, unused

KEY_BITS = 63
#: Cells that the driver holds at most per step of the search.
MAX_CELLS = 1 << 16
#: Groups that are placed one by one.
MAX_LARGE = 1024


class Cells:
    """Cells of the order, left to right: (first key, bits, sum, largest group, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[2] for r in self.rows))
        self.starts = [0, *self.ends[:-1]] if self.rows else []
        self.total = self.ends[-1] if self.rows else 0
        self.largest = max((r[3] for r in self.rows), default=0)

    def step(self, at: int, capacity: int, split: bool) -> int:
        """The furthest sum that a shard starting at `at` can reach. split: cells of several groups count as divisible."""
        to = at + capacity
        if to >= self.total:
            return self.total
        i = bisect_right(self.ends, to)  # cells before i end within the shard
        whole = self.starts[i]
        if split and self.rows[i][4] > 1:
            return to
        return max(at, whole)

    def cuts(self, capacity: int, shards: int, split: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.step(at, capacity, split)
            out.append(at)
        return out

    def smallest(self, shards: int, split: bool) -> int:
        low, high = max(self.largest, -(-self.total // shards)), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, split)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _histogram(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
    cell = F.shiftright("key", KEY_BITS - bits)
    rows = groups.groupBy(cell.alias("cell")).agg(F.sum("size"), F.max("size"), F.count("*")).collect()
    return [(r[0] << (KEY_BITS - bits), bits, r[1], r[2], r[3]) for r in rows]


def _refine(groups: DataFrame, cells: list[tuple], budget: int) -> list[tuple]:
    """The same stretch of the order in smaller cells."""
    out, spark = [], groups.sparkSession
    for bits in sorted({c[1] for c in cells}):
        mine = [c for c in cells if c[1] == bits]
        finer = min(KEY_BITS, bits + max(1, (budget // len(mine)).bit_length() - 1))
        wanted = spark.createDataFrame([(c[0] >> (KEY_BITS - bits),) for c in mine], "cell long")  # at most MAX_CELLS rows
        chosen = groups.join(F.broadcast(wanted), F.shiftright("key", KEY_BITS - bits) == wanted.cell, "left_semi")
        out += _histogram(chosen, finer)
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[tuple[int, int]], int]:
    """groups: (key, size), one row per key. Returns the shard of each large group, (first key, shard) of each shard that
    begins among the others, and the capacity.

    The order: large groups (more than a 64th of a shard's share, MAX_LARGE at most) by falling size, then all others by
    key. A group above the mean load of what is left bounds the capacity by itself; such groups (fewer than `shards`)
    are a shard each, so that the other shards stay even.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("size") * (shards * 64) > total).orderBy(F.desc("size"), "key").limit(MAX_LARGE).collect()
    shard_of: dict[int, int] = {}
    for row in large:
        if shards - len(shard_of) == 1 or row["size"] * (shards - len(shard_of)) <= total:
            break
        shard_of[row["key"]] = len(shard_of)
        total -= row["size"]
    alone, left = len(shard_of), shards - len(shard_of)
    rest = groups.join(F.broadcast(groups.sparkSession.createDataFrame([(r["key"],) for r in large], "key long")), "key", "left_anti")  # MAX_LARGE rows at most
    front = [(i - len(large), KEY_BITS, r["size"], r["size"], 1) for i, r in enumerate(large) if i >= alone]
    cells = Cells(front + _histogram(rest, 14))
    while cells.total:
        low, high = cells.smallest(left, True), cells.smallest(left, False)
        if low == high:
            break
        early, late = cells.cuts(low, left, False), cells.cuts(high, left, True)
        open_ = [i for i, row in enumerate(cells.rows) if row[4] > 1 and row[1] < KEY_BITS and any(a <= cells.ends[i] and cells.starts[i] <= b for a, b in zip(early, late))]
        if not open_:
            break
        open_ = open_[: MAX_CELLS // 2]
        gone = set(open_)
        finer = _refine(rest, [cells.rows[i] for i in open_], MAX_CELLS)
        cells = Cells([r for i, r in enumerate(cells.rows) if i not in gone] + finer)
    if not cells.total:
        return shard_of, [], 0
    first_keys = []
    ends = cells.cuts(high, left, False)
    for number, (start, end) in enumerate(zip([0, *ends], ends)):
        inside = range(bisect_left(cells.starts, start), bisect_left(cells.starts, end))
        for i in inside:
            if cells.rows[i][0] >= 0:
                first_keys.append((cells.rows[i][0], alone + number))
                break
            shard_of[large[cells.rows[i][0] + len(large)]["key"]] = alone + number
    return shard_of, first_keys, high


def shard_by_size(rows: DataFrame, group: Column, size: Column, shards: int = 16, tie: str = "doc_id") -> DataFrame:
    """Adds shard (0 to shards - 1), slot (gapless from 0 in each shard) and size to rows, in place of columns of these names; all other
    columns are kept, whatever they are called.

    Rows of equal `group` share a shard; the order of groups is that of a 63-bit hash of `group` (null is a group of its
    own). A group larger than a shard's share is a shard. Empty input gives no rows; repeated rows and rows without a tie get slots of
    their own; texts of any length are one row each."""
    spark = rows.sparkSession
    number, key, large_, bucket, n, start = (unused(rows, c) for c in ("number", "key", "large", "bucket", "n", "start"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("size", "shard", "slot")]
    keyed = rows.select(*kept, size.alias("size"), F.shiftrightunsigned(F.xxhash64(group), 1).alias(key), F.monotonically_increasing_id().alias(number))
    keyed = materialise(keyed, "sizes")
    groups = materialise(keyed.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("size")), "groups")
    shard_of, first_keys, _ = minimax_cuts(groups, shards)
    large = spark.createDataFrame(list(shard_of.items()), f"{key} long, {large_} int")  # MAX_LARGE rows at most
    shard = F.lit(0)
    for first, at in first_keys:
        shard = F.when(F.col(key) >= first, at).otherwise(shard)
    keyed = keyed.join(F.broadcast(large), key, "left")
    # Slots: each shard is dealt over buckets by a hash of the tie and the row's number (one tie may be on many rows); a bucket starts
    # where those before it end.
    buckets = max(shuffle_partitions(spark), -(-keyed.count() // (1 << 20)))
    placed = keyed.withColumn("shard", F.coalesce(large_, shard).cast("int")).withColumn(bucket, F.pmod(F.xxhash64(tie, number), F.lit(buckets)))
    counts = placed.groupBy("shard", bucket).agg(F.count("*").alias(n))
    starts = counts.selectExpr("shard", bucket, f"sum({n}) over (partition by shard order by {bucket}) - {n} as {start}")
    numbered = placed.join(starts, ["shard", bucket]).selectExpr("*", f"{start} + row_number() over (partition by shard, {bucket} order by `{tie}`, {number}) - 1 as slot")
    return numbered.select(*kept, "size", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    out = shard_by_size(docs, F.col("text_key"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
