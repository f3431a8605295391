"""Mixing of sources to target weights: how many blocks of each source go to each output shard, and which.

Documents of a source stand one after the other and are cut into blocks of equal numbers of words. A source's target fixes how many
blocks are drawn. A splitting tree over the output shards divides these quotas: each node hands a multivariate hypergeometric draw of its
sources' blocks to its left half and the rest to its right half, down to single shards, so that every shard's quotas are whole numbers
that add up exactly, and are what drawing blocks blindly would have given. A keyed permutation of each source's draws, computed
and never stored, says which block each draw is; the shards take disjoint stretches of it. Rows are shuffled only within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, flat, long_values, materialise, preceding, table

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words of a block at most, and blocks of a source at least (a block of a small source is shorter). If there were more
#: draws than numpy can split (10^9), blocks are longer.
BLOCK_WORDS, LEAST_BLOCKS, MAX_DRAWS = 256, 1024, 1 << 28
#: Groups of sources that the driver splits among shards; the sources of a group are split in a task.
GROUPS = 256
#: Pieces that a task makes at once.
PIECES = 1 << 18

_white = np.zeros(256, bool)
_white[[32, *range(9, 14)]] = True
WHITE = _white


def with_words(docs: DataFrame, keep: list[str], text_col: str = "text", name: str = "size") -> DataFrame:
    """keep, and the number of words of each whole text; a null has none."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for part in by_bytes(batch.column(len(keep)), 4 << 20):
                raw, offsets = flat(part)
                white = WHITE[np.frombuffer(raw, np.uint8)]
                begins = ~white
                begins[1:] &= white[:-1]
                inner = offsets[:-1][offsets[:-1] < len(raw)]
                begins[inner] = ~white[inner]  # a text's first byte follows no other
                before = np.concatenate(([0], np.cumsum(begins)))
                sizes.append(np.diff(before[offsets]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(sizes or [np.zeros(0)]), pa.int64())], names=[*keep, name])

    return docs.select(*keep, text_col).mapInArrow(count, f"{kinds}, `{name}` long")


def source_targets(sized: DataFrame, source_col: str = "source", size_col: str = "size", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sources in the order of their code points, null last, have the weights in turn and divide
    share x all sizes among them by weight; a target stops at most x its source's size, and what is over goes to the others by weight
    until none is above. If all stop, less than the share is given out."""
    sums = materialise(sized.groupBy(F.col(source_col)).agg(F.sum(size_col).alias("source_size")), "sources")
    numbered = preceding(sums, [], [F.col(source_col).asc_nulls_last()], F.lit(1), "turn")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("turn") % len(weights) + 1).cast("int"))
    weighed = materialise(numbered.select(source_col, "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("most")), "weights")
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (share * total / all_weights if all_weights else 0.0), 0
    while True:  # the level a unit of weight gets rises as sources stop; a round is a sum over the sources
        above = F.col("most") < F.col("weight") * level
        now, given, left = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if now == stopped:
            return weighed.select(source_col, "source_size", F.least("most", F.col("weight") * level).alias("target"), "weight")
        stopped = now
        level = (share * total - given) / left if left else float("inf")


def split(draws: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The splitting tree: draws of each colour dealt over shards of these sizes, (colours x shards); both sum to the same."""
    if len(sizes) == 1:
        return draws[:, None]
    half = len(sizes) // 2
    left = rng.multivariate_hypergeometric(draws, int(sizes[:half].sum()))
    return np.hstack([split(left, sizes[:half], rng), split(draws - left, sizes[half:], rng)])


def permuted(numbers: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 that the key chooses sends each number: a Feistel network of four rounds on the next even number
    of bits, walked until the result is below n. n and key may differ from number to number."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 2) // 2).astype(np.uint64)
    out, todo, n = numbers.astype(np.uint64), np.arange(len(numbers)), n.astype(np.uint64)
    mask, key = (np.uint64(1) << half) - np.uint64(1), key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, x = half[todo], mask[todo], out[todo]
            left, right = x >> h, x & m
            for step in range(4):
                mixed = (right + key[todo] + np.uint64(step)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def quotas(targets: DataFrame, shards: int = 16, seed: int = 0, source_col: str = "source") -> DataFrame:
    """Adds to the sources' targets: words of a block, blocks, whole passes over all blocks, blocks of the last pass, draws in all, and
    starts, where in the source's draws each shard begins (the last entry is their end). Shards get as many draws as each other, give or
    take one. The driver holds a number for each group of sources and shard, never one for each source."""
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    longest = max(BLOCK_WORDS, int(total / MAX_DRAWS) + 1)
    block = F.greatest(F.lit(1), F.least(F.lit(longest), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long")
    plan = targets.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / F.col("block")).cast("long")
    plan = plan.withColumn("rest", F.least(rest, F.col("blocks"))).withColumn("draws", F.col("passes") * F.col("blocks") + F.col("rest"))
    plan = materialise(plan.withColumn("part", F.pmod(F.xxhash64(source_col), F.lit(GROUPS)).cast("int")), "quotas")
    of_part = dict(plan.groupBy("part").agg(F.sum("draws")).collect())  # GROUPS rows at most
    parts = sorted(of_part)
    draws = np.array([of_part[p] for p in parts], np.int64)
    sizes = (int(draws.sum()) + np.arange(shards)[::-1]) // shards
    dealt = dict(zip(parts, split(draws, sizes, np.random.default_rng([seed, GROUPS])))) if parts else {}

    def divide(key: tuple, rows: pa.Table) -> pa.Table:
        rows, number = rows.sort_by(source_col), key[0].as_py()
        shared = split(rows["draws"].to_numpy(), dealt[number], np.random.default_rng([seed, number]))
        starts = np.hstack([np.zeros((len(rows), 1), np.int64), np.cumsum(shared, axis=1)])
        return rows.drop_columns(["part"]).append_column("starts", pa.array(starts.tolist(), pa.list_(pa.int64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema if f.name != "part")
    return materialise(plan.groupBy("part").applyInArrow(divide, f"{fields}, starts array<long>"), "starts")


def mix(sized: DataFrame, plan: DataFrame, order: list[Column], seed: int = 0, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """The pieces of documents that the mix takes: all columns of sized, row (a number for each of its rows), source_size and target of
    its source, pass, start and words (the piece, in words of its document), shard, and place (of the block among its source's draws). A document of which nothing is taken
    comes once, with words 0 and no shard. Documents of a source are cut into blocks in the given order."""
    base = sized.drop("row", "source_size", "target", "pass", "start", "words", "shard", "place")
    placed = preceding(base, [source_col], order, F.col(size_col), "begin_", "row")
    mine = plan.select(F.col(source_col).alias("source_"), "source_size", "target", *(F.col(c).alias(f"{c}_") for c in ("block", "blocks", "passes", "rest", "draws", "starts")))
    joined = placed.join(mine, F.col(source_col).eqNullSafe(F.col("source_"))).withColumn("key_", F.xxhash64(F.lit(seed), "source_")).drop("source_")
    names = [*base.columns, "row", "source_size", "target"]
    kinds = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {c: batch.column(batch.schema.get_field_index(c)) for c in (size_col, "begin_", "block_", "blocks_", "passes_", "rest_", "draws_", "key_")}
            size, begin, block, blocks, passes, rest, draws, key = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in by.values())
            starts = batch.column(batch.schema.get_field_index("starts_")).flatten().to_numpy().reshape(len(batch), -1)
            first = begin // block
            n = np.where(size > 0, (begin + size - 1) // block - first + 1, 0)
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), PIECES)) + at)
                of = np.repeat(np.arange(at, to), n[at:to])
                number = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
                rank = permuted(number, blocks[of], key[of])
                turns = passes[of] + (rank < rest[of])  # how often the block is drawn
                again = np.repeat(np.arange(len(of)), turns)
                pass_ = np.arange(len(again)) - np.repeat(np.cumsum(turns) - turns, turns)
                doc, number = of[again], number[again]
                draw = np.where(pass_ < passes[doc], pass_ * blocks[doc] + number, passes[doc] * blocks[doc] + rank[again])
                place = permuted(draw, draws[doc], ~key[doc])
                shard = (place[:, None] >= starts[doc, 1:]).sum(axis=1)
                start = np.maximum(0, number * block[doc] - begin[doc])
                words = np.minimum(size[doc], (number + 1) * block[doc] - begin[doc]) - start
                none = np.setdiff1d(np.arange(at, to), doc)
                empty, lone = pa.nulls(len(none), pa.int64()), pa.array(np.zeros(len(none), np.int64))
                columns = [pa.concat_arrays([pa.array(x, pa.int64()), lone if x is words else empty]) for x in (pass_, start, words, shard, place)]
                columns[3] = columns[3].cast(pa.int32())
                rows = batch.select(names).take(pa.array(np.concatenate([doc, none])))
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*names, "pass", "start", "words", "shard", "place"])
                at = to

    return joined.mapInArrow(cut, f"{kinds}, pass long, start long, words long, shard int, place long")


def shuffled(pieces: DataFrame, seed: int = 0, source_col: str = "source") -> DataFrame:
    """The pieces that have a shard, each shard's in an order drawn at random; a shard is dealt over as many tasks as it needs."""
    drawn = pieces.where("shard is not null").withColumn("order_", F.xxhash64(F.lit(seed), source_col, "place"))
    return drawn.repartitionByRange("shard", "order_", "row").sortWithinPartitions("shard", "order_", "row").drop("order_")


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(id, source, size, source_size, target, and the pieces of mix()) for all documents; reruns agree.

    Null and empty texts have no word and are never taken; a null source is a source. Documents of a source are cut into blocks in the
    order of their ids, null ids first; equal rows are documents of their own. What is taken of a source misses its target by less than
    two blocks; no word is taken more often than `most`, rounded up. An empty table gives no rows. Other columns play no part."""
    sized = materialise(with_words(docs, [id_col, source_col], text_col), "sizes")
    targets = source_targets(sized, source_col, weights=weights, share=share, most=most)
    plan = quotas(targets, shards, seed, source_col)
    return mix(sized, plan, [F.col(id_col)], seed, source_col)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, summed over its pieces."""
    long_values(spark)
    pieces = mix_documents(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return taken.drop("row")
