"""Streaming forms: event time is the packet's, late rows are dropped by the watermark. State is keyed and kept by Spark, so that a lost
executor costs a replay of the batch at most. It goes when the watermark has passed the time from which it decides nothing any more; only
running means (live_baseline) and stopped captures (stop_stream) are kept for each key for good, a few numbers each."""

from __future__ import annotations

from collections import Counter, OrderedDict, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from ..operators.blocks import unused
from ..sources.adapters import PACKET_COLUMNS, SPARK_K, micros, table
from ..sources.scratch import new_folder

WATERMARK = "10 seconds"
#: Input that one batch takes at most: what a task holds of a key is a part of it.
BATCH_BYTES = 1 << 30


def packet_stream(spark: SparkSession, sf_dir: str, watermark: str = WATERMARK) -> DataFrame:
    """The packets of the events table as a stream, with event time `at`."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern, since a stream's plain path would have to be a folder; it names a single file as well as a folder of them.
    events = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{sf_dir}/events.parque[t]").selectExpr("*", f"{SPARK_K} as k")
    rows = events.selectExpr(*(f"{e} as {n}" for n, e in PACKET_COLUMNS.items()), f"{micros('ts')} as us", "hour(ts) as hour", "weekday(ts) as weekday")
    return rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", watermark)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; then they are as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop because the watermark has passed them: dropped[query id]. Register it with
    spark.streams.addListener. Rows are counted where they meet state, so after a partial sum if the stream aggregates."""

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped[str(event.progress.id)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def drain(stream: DataFrame, mode: str = "append", started_with: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote. Each batch is written under its number, so that a repeated batch replaces
    itself; in complete mode the last batch is the result. The stream has the session's settings and those of started_with."""
    spark = stream.sparkSession
    out, state = new_folder(spark, "stream"), new_folder(spark, "stream-state")
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        numbers.append(number)

    with settings(spark, started_with or {}):
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(numbers))[-1:] if mode == "complete" else sorted(set(numbers))
    schema = stream.schema
    return spark.read.schema(schema).parquet(*(f"{out}/batch={n}" for n in wanted)) if wanted else spark.createDataFrame([], schema)


def tumbling_rates(stream: DataFrame, length: str) -> DataFrame:
    return stream.groupBy(F.window("at", length)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(F.unix_micros("window.start").alias("start_us"), "packets", "bytes")


def sliding_totals(stream: DataFrame, length: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("at", length, step)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(F.unix_micros("window.start").alias("start_us"), "packets", "bytes")


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Each value once, as it first comes; it counts as new again when it has not come for the stream's watermark delay."""
    return stream.dropDuplicatesWithinWatermark([key])


#: Groups that the keys of a stream are dealt to. A call of Python costs milliseconds, so keys share one; the state of a group is that of its keys.
GROUPS = 1 << 12
#: Rows of a group that are held before those that decide nothing are dropped.
HELD_ROWS = 1 << 16


def stateful(
    stream: DataFrame, keys: list[str], output: str, state: str, step: Callable, columns: list[str], timeout: str = GroupStateTimeout.EventTimeTimeout, wanted: Callable[[pd.DataFrame], pd.DataFrame] | None = None
) -> DataFrame:
    """step(key, rows in order, state tuple or None) -> (output tuples, new state tuple or None to drop it); rows are lists by column. With
    event-time timers a state's first field is the time in microseconds from which it decides nothing: then step gets None for rows.

    Keys are dealt to GROUPS by hash. wanted: of rows of a group in order, those that may decide anything whatever rows of the same batch are
    still to come; without it a task holds all rows that one batch has of a group."""
    group_key, = unused(stream, "group")
    timed = timeout == GroupStateTimeout.EventTimeTimeout
    order = ["us", "seq"]
    names = list(dict.fromkeys([*keys, *columns, *order]))
    fields = StructType.fromDDL(output).fields
    kept = StructType([StructField("states", ArrayType(StructType([StructField("key", StructType([stream.schema[k] for k in keys])), StructField("value", StructType.fromDDL(state))])))])
    kinds = {"long": "Int64", "integer": "Int32", "double": "float64", "boolean": "boolean"}

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({f.name: pd.Series(c, dtype=kinds.get(f.dataType.typeName(), "object")) for f, c in zip(fields, zip(*out) if out else [()] * len(fields))})

    def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        parts, held = [], 0
        for part in frames:  # parts of one batch
            parts.append(part[names])
            held += len(part)
            if wanted and held > HELD_ROWS:
                parts = [wanted(pd.concat(parts).sort_values(order, kind="stable", ignore_index=True))]
                held = 0
        return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(order, kind="stable", ignore_index=True)

    def by_key(rows: pd.DataFrame) -> dict[tuple, dict[str, list]]:
        lists = {n: rows[n].tolist() for n in names}
        out: dict[tuple, dict[str, list]] = {}
        for row in zip(*lists.values()):
            key = tuple(None if v != v else v for v in row[: len(keys)])
            if key not in out:
                out[key] = {n: [] for n in names}
            for n, v in zip(names, row):
                out[key][n].append(v)
        return out

    def run(_: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        states = {tuple(k): tuple(v) for k, v in group.get[0]} if group.exists else {}
        passed = group.getCurrentWatermarkMs() if timed else 0
        rows = {} if group.hasTimedOut else by_key(in_order(frames))
        out: list[tuple] = []
        for key in [*rows, *(k for k, s in states.items() if timed and k not in rows and s[0] // 1000 < passed)]:
            found, new = step(key, rows.get(key), states.get(key))
            out += found
            if new is None:
                states.pop(key, None)
            else:
                states[key] = new
        if states:
            group.update(([(k, s) for k, s in states.items()],))
            if timed:
                group.setTimeoutTimestamp(max(passed + 1, min(s[0] for s in states.values()) // 1000))
        elif group.exists:
            group.remove()
        yield frame(out)

    dealt = stream.withColumn(group_key, F.pmod(F.xxhash64(*keys), F.lit(GROUPS)))
    return dealt.select(group_key, *names, "at").groupBy(group_key).applyInPandasWithState(run, output, kept, "append", timeout)


def _seqs(values: list[int]) -> list[tuple]:
    return [(v,) for v in values]


def cooldown(stream: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Rows that fire: at least so long after the last of their key that fired. A key is forgotten when its time is over."""
    gap = int(seconds * 1_000_000)

    def step(key, rows, state):
        if rows is None:
            return _seqs([]), None
        free, out = (state[0] if state else None), []
        for t, seq in zip(rows["us"], rows["seq"]):
            if free is None or t >= free:
                free = t + gap
                out.append(seq)
        return _seqs(out), (free,)

    return stateful(stream, keys, "seq long", "free long", step, [])


def rate_limited(stream: DataFrame, key: str, limit: int, seconds: float) -> DataFrame:
    """Requests beyond the limit within the time from a client's first request; then a new time begins, and the client is forgotten."""
    span = int(seconds * 1_000_000)

    def step(_, rows, state):
        if rows is None:
            return _seqs([]), None
        end, used = state or (None, 0)
        out = []
        for t, seq in zip(rows["us"], rows["seq"]):
            if end is None or t >= end:
                end, used = t + span, 0
            used += 1
            if used > limit:
                out.append(seq)
        return _seqs(out), (end, used)

    return stateful(stream, [key], "seq long", "end long, used long", step, [])


def call_sessions(stream: DataFrame, keys: list[str], idle_seconds: float = 3600) -> DataFrame:
    """Sessions as they end: finished by a chunk with closes true, or not, when nothing has come for the idle time. Chunks, tokens, start and
    end. A key without an open session has no state."""
    idle = int(idle_seconds * 1_000_000)

    def step(key, rows, state):
        out = []
        if rows is None:
            due, start, chunks, tokens = state
            return [(*key, start, due - idle, chunks, tokens, False)], None
        due, start, chunks, tokens = state or (0, 0, 0, 0)
        for t, n, closes in zip(rows["us"], rows["length"], rows["closes"]):
            if chunks and t > due:
                out.append((*key, start, due - idle, chunks, tokens, False))
                chunks = tokens = 0
            start = t if chunks == 0 else start
            due, chunks, tokens = t + idle, chunks + 1, tokens + int(n)
            if closes:
                out.append((*key, start, t, chunks, tokens, True))
                chunks = tokens = 0
        return out, (due, start, chunks, tokens) if chunks else None

    fields = ", ".join(f"{k} string" for k in keys)
    return stateful(stream, keys, f"{fields}, start_us long, end_us long, chunks long, tokens long, finished boolean", "due long, start long, chunks long, tokens long", step, ["length", "closes"])


def silent(stream: DataFrame, key: str, seconds: float) -> DataFrame:
    """A row when a key has been silent for the time: noticed at its next row, or by an event-time timer."""
    span = int(seconds * 1_000_000)

    def step(k, rows, state):
        if rows is None:  # the timer
            return [(k[0], state[1])], None
        last, out = (state[1] if state else None), []
        for t in rows["us"]:
            if last is not None and t - last > span:
                out.append((k[0], last))
            last = t
        return out, (last + span, last)

    return stateful(stream, [key], f"{key} string, since_us long", "due long, last long", step, [])


def stop_stream(stream: DataFrame, key: str, packets: int | None = None, byte_limit: int | None = None, seconds: float | None = None) -> DataFrame:
    """Rows of each capture, in time order, up to the first that reaches a number of packets, of bytes, or a duration; then it stays stopped."""
    span = None if seconds is None else int(seconds * 1_000_000)

    def step(_, rows, state):
        start, count, used, stopped = state or (None, 0, 0, False)
        out = []
        for t, seq, n in zip(rows["us"], rows["seq"], rows["length"]):
            start = t if start is None else start
            stopped = stopped or count == packets or (byte_limit is not None and used >= byte_limit) or (span is not None and t - start > span)
            if stopped:
                break
            count, used = count + 1, used + int(n)
            out.append(seq)
        return _seqs(out), (start, count, used, stopped)

    def wanted(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows in order that an earlier row which is still to come cannot push beyond the number or, but for the first beyond, the duration.
        (Bytes do not tell: lengths below 0 would bring them down again.)"""
        of_key = rows.groupby(key, sort=False, dropna=False)
        near = pd.Series(True, rows.index) if packets is None else of_key.cumcount() <= packets
        if span is not None:
            beyond = (rows["us"] - of_key["us"].transform("min") > span).astype("int64")
            near &= beyond.groupby(rows[key], sort=False, dropna=False).cumsum() <= 1
        return rows[near]

    return stateful(stream, [key], "seq long", "start long, count long, used long, stopped boolean", step, ["length"], GroupStateTimeout.NoTimeout, wanted)


def rolling_flows(stream: DataFrame, keys: list[str], idle: str) -> DataFrame:
    """Flows that end after an idle time."""
    return stream.groupBy(*keys, F.session_window("at", idle)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(*keys, F.unix_micros("session_window.start").alias("start_us"), "packets", "bytes")


def live_baseline(stream: DataFrame, key: str, limit: float = 3.0) -> DataFrame:
    """Packets that lie more than the limit of deviations above their key's mean so far (Welford's update)."""

    def step(_, rows, state):
        n, mean, m2 = state if state else (0, 0.0, 0.0)
        out = []
        for seq, x in zip(rows["seq"], rows["length"]):
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            if sd > 0 and (x - mean) / sd > limit:
                out.append(seq)
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
        return _seqs(out), (n, mean, m2)

    return stateful(stream, [key], "seq long", "n long, mean double, m2 double", step, ["length"], GroupStateTimeout.NoTimeout)


#: Session settings for streams with several kinds of state a key (live_scores): a stream takes its store as it first starts and keeps it.
MANY_STATES = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class HostScores(StatefulProcessor):
    """State of a host: a few running sums, sums of the hours of a week that it was seen in, and an entry for each destination that it knows.
    A batch reads and writes the entries of its own rows only, however many a host has."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "due long, n long, lengths long, total double, squares double, top double")
        self.slots = handle.getMapState("slots", "slot int", "total double, lengths long")
        self.known = handle.getMapState("known", "peer long", "since long")

    def _forget(self) -> None:
        self.sums.clear()
        self.slots.clear()
        self.known.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")  # a part of one batch
        due, n, lengths, total, squares, top = self.sums.get() or (0, 0, 0, 0.0, 0.0, 0.0)
        fresh = n == 0  # nothing is kept of the host: then its entries need not be asked for
        if n:
            self.handle.deleteTimer(due // 1000 + 1)
        slots: dict[int, tuple[float, int]] = {}  # entries of this batch's hours and destinations
        peers: dict[int, bool] = {}
        out = []
        for t, seq, x, hour, slot, peer in zip(*(batch[c].tolist() for c in ("us", "seq", "length", "hour", "slot", "peer"))):
            if n and t > due:  # silent for too long within one batch
                self._forget()
                n, lengths, total, squares, top = 0, 0, 0.0, 0.0, 0.0
                slots, peers, fresh = {}, {}, True
            x = None if pd.isna(x) else float(x)
            if slot not in slots:
                slots[slot] = (0.0, 0) if fresh else tuple(self.slots.getValue((slot,)) or (0.0, 0))
            if peer not in peers:
                peers[peer] = not fresh and self.known.containsKey((peer,))
            mean = total / lengths if lengths else None
            found = []
            if x is not None and lengths:
                deviation = (squares / (lengths - 1)) ** 0.5 if lengths > 1 else 0.0
                z = (x - mean) / deviation if deviation > 0 else 0.0
                ratio = x / mean if mean else None
                if z > 3 or (ratio is not None and ratio >= 2):
                    found.append(("CONNECTIONS", z if ratio is None else max(ratio, z)))
            of_slot, in_slot = slots[slot]
            if n and not 6 <= hour <= 21 and (not in_slot or of_slot / in_slot < 50):
                found.append(("OFF_HOURS", 3.5))
            if n and not peers[peer]:
                found.append(("FIRST_CONTACT", 3.0))
            if x is not None and lengths and top > 0 and x >= 2 * top:
                found.append(("VOLUME", 2 * x / top))
            worst = max((v for _, v in found), default=0.0)
            out.append((seq, ",".join(name for name, _ in found), min(100.0, max(10.0, 15 * max(worst, 0.0) + 10 * len(found))) if found else 0.0))
            n, due = n + 1, t + self.keep
            if not peers[peer]:
                self.known.updateValue((peer,), (t,))
                peers[peer] = True
            if x is not None:
                top = max(top, x) if lengths else x
                lengths, total = lengths + 1, total + x
                squares += (x - (mean or 0.0)) * (x - total / lengths) if mean is not None else 0.0
                slots[slot] = (of_slot + x, in_slot + 1)
        for slot, entry in slots.items():
            self.slots.updateValue((slot,), entry)
        self.sums.update((due, n, lengths, total, squares, top))
        self.handle.registerTimer(due // 1000 + 1)
        yield pd.DataFrame(out, columns=["seq", "reasons", "score"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


def live_scores(stream: DataFrame, key: str, forget_seconds: float = 90 * 86400) -> DataFrame:
    """(seq, reasons, score): the live form of baseline.host_scores. A host that has been silent for the time is forgotten, by an event-time
    timer. A null length counts as a packet but not as a length; destinations are known by 64-bit hashes. The stream must be started with the
    settings MANY_STATES. (In processing-time mode, which state with a time to live would ask for, a stream that is to take what there is
    never ends: each batch is followed by another one without rows.)"""
    marked = stream.withColumns({"slot": (F.col("weekday") * 24 + F.col("hour")).cast("int"), "peer": F.xxhash64("dst")})
    rows = marked.select(key, "us", "seq", "at", "length", "hour", "slot", "peer")
    return rows.groupBy(key).transformWithStateInPandas(HostScores(int(forget_seconds * 1_000_000)), "seq long, reasons string, score double", "append", "eventTime")


def stream_pairs(messages: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """(request_seq, response_seq, confidence, method): at most one response for each request of a key, as they come. messages: keys, us, seq,
    at, is_request, id.

    A response takes the oldest waiting request of its id (header, 0.95), else the newest that waits (timing, 0.6), none older than the
    time; a response with an id that finds none is an orphan (0.5). A request that was taken waits no more. The state of a key is its
    waiting requests; it goes when the watermark has passed the time of the last of them."""
    span = int(seconds * 1_000_000)

    def step(_, rows, state):
        if rows is None:
            return [], None
        _, *held = state or (0, [], [], [])
        out: list[tuple] = []
        waiting: OrderedDict[int, tuple[int, int, str | None]] = OrderedDict()  # by a number of their own, oldest first
        of_id: dict[str, deque[int]] = {}  # numbers of an id, those that wait no more among them
        arrived = 0

        def wait(seq, t, known):
            nonlocal arrived
            waiting[arrived] = (seq, t, known)
            if known is not None:
                of_id.setdefault(known, deque()).append(arrived)
            arrived += 1

        for seq, t, i in zip(*held):
            wait(seq, t, None if i == "" else i[1:])
        for t, seq, is_request, id_ in zip(rows["us"], rows["seq"], rows["is_request"], rows["id"]):
            known = None if id_ is None or id_ != id_ else id_
            while waiting and t - waiting[next(iter(waiting))][1] > span:
                waiting.popitem(last=False)
            if is_request:
                wait(seq, t, known)
                continue
            same = of_id.get(known, deque()) if known is not None else deque()
            while same and same[0] not in waiting:
                same.popleft()
            if same:
                out.append((waiting.pop(same.popleft())[0], seq, 0.95, "header"))
            elif waiting:
                out.append((waiting.popitem()[1][0], seq, 0.6, "timing"))
            elif known is not None:
                out.append((None, seq, 0.5, "orphan"))
        if not waiting:
            return out, None
        left = list(waiting.values())
        return out, (max(w[1] for w in left) + span, [int(w[0]) for w in left], [int(w[1]) for w in left], ["" if w[2] is None else f"={w[2]}" for w in left])

    return stateful(messages, keys, "request_seq long, response_seq long, confidence double, method string", "due long, seqs array<long>, times array<long>, ids array<string>", step, ["is_request", "id"])


def stop_after(rows: DataFrame, packets: int | None = None, byte_limit: int | None = None, seconds: float | None = None, order: str = "seq", partition: str | None = None) -> DataFrame:
    """Batch form of the stop conditions: rows up to the first that reaches a number of packets, of bytes, or a duration."""
    by = f"partition by {partition} " if partition else ""
    w = f"over ({by}order by {order} rows between unbounded preceding and current row)"
    out = rows.selectExpr("*", f"count(*) {w} as _n", f"sum(length) {w} - length as _bytes", f"us - min(us) {w} as _us")
    for name, limit in (("_n", packets), ("_bytes", byte_limit), ("_us", None if seconds is None else int(seconds * 1_000_000))):
        if limit is not None:
            out = out.where(f"{name} <= {limit}" if name != "_bytes" else f"{name} < {limit}")
    return out.drop("_n", "_bytes", "_us")
