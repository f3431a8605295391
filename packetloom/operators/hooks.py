"""Places for a user's own code: decoders, aggregates, table functions, and rules as data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from . import blocks, filters


def decode_unmatched(rows: DataFrame, unmatched: Column, data: str, decoder: Callable[[bytes], tuple[str, str] | None]) -> DataFrame:
    """Adds decoded_protocol and decoded_summary by a user's decoder, which sees only the rows that nothing else matched; None leaves nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x.as_py() is None else decoder(x.as_py()) for x in batch.column(batch.schema.get_field_index(data))]
            texts = [pa.array([f[i] if f else None for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *texts], names=[*batch.schema.names, "decoded_protocol", "decoded_summary"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rest = rows.where(~filters.two_valued(unmatched))
    return rest.withColumns({"decoded_protocol": F.lit(None).cast("string"), "decoded_summary": F.lit(None).cast("string")}).union(rows.where(filters.two_valued(unmatched)).mapInArrow(run, f"{fields}, decoded_protocol string, decoded_summary string"))


#: Keys whose states a task holds at once.
HELD_KEYS = 50_000


def aggregate_states(rows: DataFrame, keys: list[str], columns: list[str], schema: str, start: Callable[[], Any], add: Callable[..., Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], tuple]) -> DataFrame:
    """A user's aggregate in parts: add(state, *values) takes in a row, merge(state, state) joins two states, finish(state) gives the columns of
    the schema (without the keys). Each task adds its rows up by key before the shuffle, and the states of a key are merged one by one as
    they come, so that no key's rows are ever together. States are pickled. A null key is a key like any other."""
    names = [f.name for f in StructType.fromDDL(schema).fields]
    added = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    kinds = [to_arrow_type(rows.schema[k].dataType) for k in keys]
    state, = blocks.unused(rows.select(*keys), "state")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}

        def flush() -> pa.RecordBatch:
            out = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            out.append(pa.array(map(pickle.dumps, held.values()), pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=[*keys, state])

        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*values):
                key = row[: len(keys)]
                held[key] = add(held[key] if key in held else start(), *row[len(keys) :])
                if len(held) >= HELD_KEYS:
                    yield flush()
        yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None

        def out(ready: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*ready)) or [()] * (len(keys) + len(added))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [*kinds, *added])], names=[*keys, *names])

        for batch in batches:
            ready = []
            for *key, raw in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                part = pickle.loads(raw)
                if key == last:
                    now = merge(now, part)
                    continue
                if last is not None:
                    ready.append((*last, *finish(now)))
                last, now = key, part
            yield out(ready)
        yield out([] if last is None else [(*last, *finish(now))])

    parts = rows.select(*keys, *columns).mapInArrow(add_up, StructType([*(rows.schema[k] for k in keys), StructField(state, BinaryType())]))
    result = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(schema).fields])
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, result)


def aggregate(rows: DataFrame, keys: list[str], schema: str, function: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A user's aggregate over whole groups: function gets the rows of a key and returns rows of the schema. A key is one task's work; where
    the aggregate can be made in parts, use aggregate_states."""
    return rows.groupBy(*keys).applyInPandas(function, schema)


def table_function(rows: DataFrame, columns: list[str], schema: str, function: Callable[..., Iterator[tuple]]) -> DataFrame:
    """A user's function from a row to many rows, as a lateral join: row columns, then those of the schema."""
    from pyspark.sql.functions import udtf

    class Handler:
        def eval(self, *args):
            yield from function(*args)

    call = udtf(Handler, returnType=schema)
    return rows.lateralJoin(call(*(F.col(c).outer() for c in columns)))


def apply_rule_table(rows: DataFrame, rules: list[dict], fields: dict[str, str]) -> DataFrame:
    """(row, rule, severity): rules as data, each {"name", "severity", "when": hunt tree}; predicates are built as Columns, never run as code."""
    found = F.array_compact(F.array(*(F.when(filters.hunt(r["when"], fields, typed=True), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["severity"]).alias("rule_severity"))) for r in rules)))
    return rows.select("*", F.explode(found).alias("_r")).select(*rows.columns, "_r.*")
