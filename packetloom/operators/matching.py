"""Joins of rows with rule tables whose fields may be left open, and with lists of words that a text may hold."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import unused

#: Rule and dimension tables of up to so many rows and bytes (as JSON) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
#: First characters of a word by which texts are looked up when there are too many words to broadcast.
GRAM = 6
#: Rows found that a task hands on at once.
FOUND_ROWS = 10_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has no more than so many rows and bytes; counted by Spark, at most rows + 1 of them."""
    n, used = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= rows and used <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to be small; beyond that Spark chooses."""
    return F.broadcast(df) if is_small(df, rows) else df


def by_pattern(rows: DataFrame, rules: DataFrame, fields: dict[str, str], keep: list[str], rows_limit: int = BROADCAST_ROWS) -> DataFrame:
    """(row, kept rule columns): rules whose set fields all equal the row's; a null field matches anything, a null of the row only that.
    fields: rule column -> row column. Kept rule columns replace row columns of the same name.

    Each row is dealt once for each pattern of set fields that the rules have (2^fields at most), so that all rules join on equality: a
    hash join where the rules are small, else a shuffle whose hot keys AQE splits. Only rules without any field meet every row."""
    pattern, *keys = unused(rows, "pattern", *(f"key{i}" for i in range(len(fields))))
    mask = sum((F.when(F.col(f"`{f}`").isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    kept = [F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)]
    marked = rules.select(*(F.col(f"`{f}`").alias(f"field{i}") for i, f in enumerate(fields)), *kept, mask.cast("int").alias("mask"))
    patterns = sorted(r[0] for r in marked.select("mask").distinct().collect())  # 2^fields numbers at most
    dealt = rows.select("*", F.explode(F.array(*map(F.lit, patterns)).cast("array<int>")).alias(pattern))
    dealt = dealt.withColumns({k: F.when(F.col(pattern).bitwiseAND(F.lit(1 << i)) != 0, F.col(f"`{c}`")) for i, (k, c) in enumerate(zip(keys, fields.values()))})
    same = F.col(f"e.{pattern}") == F.col("r.mask")
    for i, k in enumerate(keys):
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"r.field{i}"))
    replaced = {c.lower() for c in keep}
    own = [F.col(f"e.`{c}`") for c in rows.columns if c.lower() not in replaced]
    return dealt.alias("e").join(small(marked, rows_limit).alias("r"), same).select(*own, *(F.col(f"r.kept{i}").alias(c) for i, c in enumerate(keep)))


def holding(rows: DataFrame, key: str, text: Column, listed: DataFrame, words: Column, rows_limit: int = BROADCAST_ROWS) -> DataFrame:
    """(row, listed columns): each row with the different listed rows whose words its text holds; a null text holds none.

    The words of a list that was counted to be small are sent to all tasks, which build one Aho-Corasick automaton of them and read each
    text once, however many words there are. For a larger list, the runs of characters of each text are joined with the first characters of
    the words on equality, under the row's key alone, and the pairs found are tested on the whole text; rows may share a key."""
    listed = listed.where(words.isNotNull()).distinct()
    if is_small(listed, rows_limit):
        return _by_automaton(rows, text, listed, words)
    starts = listed.withColumn("_start", F.substring(words, 1, GRAM))
    sizes = sorted(r[0] for r in starts.select(F.length("_start")).distinct().collect())  # GRAM + 1 at most
    runs = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit("")) for n in sizes)))
    pairs = rows.select(F.col(key).alias("_row"), F.explode(runs).alias("_start")).join(starts, "_start").select("_row", *listed.columns).distinct()
    return rows.join(pairs, F.col(key).eqNullSafe(F.col("_row"))).where(F.contains(text, words)).drop("_row")


def _by_automaton(rows: DataFrame, text: Column, listed: DataFrame, words: Column) -> DataFrame:
    searched, word = unused(rows.select("*", *(F.lit(0).alias(c) for c in listed.columns if c not in rows.columns)), "searched", "word")
    marked = listed.withColumn(word, words)
    shipped = rows.sparkSession.sparkContext.broadcast([r[0] for r in marked.select(word).distinct().collect()])  # counted by the caller

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = ahocorasick.Automaton(), {w for w in shipped.value if not w}
        for w in shipped.value:
            if w:
                automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                held = value.as_py()
                if held is None:
                    continue
                hits = always | ({w for _, w in automaton.iter(held)} if len(automaton) else set())
                at += [i] * len(hits)
                found += hits
                if len(found) >= FOUND_ROWS:
                    yield _taken(batch, at, found, word)
                    at, found = [], []
            yield _taken(batch, at, found, word)

    fields = StructType([*rows.schema.fields, StructField(word, StringType())])
    hits = rows.withColumn(searched, text).mapInArrow(find, fields)
    return hits.join(F.broadcast(marked), word).drop(word)  # counted by the caller


def _taken(batch: pa.RecordBatch, at: list[int], words: list[str], name: str) -> pa.RecordBatch:
    kept = batch.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(words, pa.string())], names=[*batch.schema.names[:-1], name])
