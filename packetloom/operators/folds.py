"""Ordered folds: recurrences whose next state depends on what fired before, so that no window frame can say them.

Rows are dealt by key and sorted by key and order within each task; a task walks over its rows in Arrow batches and carries the state of one key
at a time, so that it never holds a key's rows. Rows should be filtered to candidates first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], advance: Callable[..., tuple[Any, Any]], result: str | None = None) -> DataFrame:
    """advance(state, *values of the columns) -> (state, value), from state None at the first row of each key. With a result ("name type") the
    values are a new column, in place of one of that name; without, they say which rows stay.

    A null key is a key like any other. A row with a null in one of the columns leaves the state as it is: its value is null, or it goes.
    Other columns pass through as they are, whatever their type."""
    added = StructType.fromDDL(result).fields if result else []
    rows = rows.drop(*(f.name for f in added))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = object()
        state = None
        for batch in batches:
            out = []
            named = dict(zip(batch.schema.names, batch.columns))
            for key, values in zip(zip(*(map(_same, named[k].to_pylist()) for k in keys)), zip(*(named[c].to_pylist() for c in columns))):
                if key != last:
                    last, state = key, None
                value = None
                if None not in values:
                    state, value = advance(state, *values)
                out.append(value)
            if added:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, to_arrow_type(added[0].dataType))], names=[*batch.schema.names, added[0].name])
            else:
                yield batch.filter(pa.array(out, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, StructType([*rows.schema.fields, *added]))


def _same(value: Any) -> Any:
    """The value, or a name for not-a-number, which does not equal itself."""
    return value if value == value else "NaN"


def cooldown(rows: DataFrame, keys: list[str], seconds: float, time: str = "us", order: str = "seq") -> DataFrame:
    """Keeps a row if the last kept one of its key is at least so many seconds back: greedy, from the last that fired."""
    gap = int(seconds * 1_000_000)

    def advance(last, t):
        return (t, True) if last is None or t - last >= gap else (last, False)

    return fold(rows, keys, [time, order], [time], advance)


def threshold_alerts(rows: DataFrame, keys: list[str], count: int, seconds: float, time: str = "us", order: str = "seq") -> DataFrame:
    """Rows at which a key has `count` matches within the window; the queue, never longer than count, is emptied when it fires."""
    span = int(seconds * 1_000_000)

    def advance(queue, t):
        queue = [x for x in queue or () if t - x <= span] + [t]
        return ([], True) if len(queue) >= count else (queue, False)

    return fold(rows, keys, [time, order], [time], advance)


def anchored_distinct(rows: DataFrame, key: str, value: str, least: int, seconds: float, time: str = "us", order: str = "seq") -> DataFrame:
    """Rows at which a key has seen `least` distinct values in a span that starts at its first row; a row beyond the span starts anew."""
    span = int(seconds * 1_000_000)

    def advance(state, t, v):
        start, seen = state if state and t - state[0] <= span else (t, set())
        new = v not in seen
        seen.add(v)
        return (start, seen), new and len(seen) >= least

    return fold(rows, [key], [time, order], [time, value], advance)


def split_greedy(rows: DataFrame, keys: list[str], limit: float, by: str, time: str = "us", order: str = "seq", length: str = "length") -> DataFrame:
    """Adds chunk: by "time" a chunk holds rows up to limit seconds after its first; by "bytes" rows up to limit bytes (one row at least)."""

    def by_time(state, t):
        chunk, start = state or (0, t)
        if t - start >= limit * 1_000_000:
            chunk, start = chunk + 1, t
        return (chunk, start), chunk

    def by_bytes(state, n):
        chunk, used = state or (0, 0)
        if used and used + n > limit:
            chunk, used = chunk + 1, 0
        return (chunk, used + n), chunk

    return fold(rows, keys, [order], [time if by == "time" else length], by_time if by == "time" else by_bytes, "chunk long")


def lockouts(attempts: DataFrame, key: str, failures: int, seconds: int, time: str = "us", order: str = "seq") -> DataFrame:
    """Failed attempts that lock a key: the failures since its last success reach the number; locked_until is that many seconds on."""
    w = f"partition by {key} order by {time}, {order}"
    marked = attempts.selectExpr("*", f"count_if(success) over ({w} rows between unbounded preceding and current row) as _island")
    counted = marked.selectExpr("*", f"count_if(not success) over (partition by {key}, _island order by {time}, {order} rows between unbounded preceding and current row) as failed")
    return counted.where(f"not success and failed >= {failures}").withColumn("locked_until", F.col(time) + seconds * 1_000_000).drop("_island")

