"""State of streams over several batches, and that it goes when the watermark has passed."""

import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.streaming import queries as st

SECOND = 1_000_000
BASE = 1_000_000 * SECOND  # a watermark begins at 0


@pytest.fixture()
def feed(spark):
    """A function that writes a batch of (src, seconds, closes), and the stream over all batches, one file a batch."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "src string, us long, seq long, length long, closes boolean"
    count = 0

    def put(*rows):
        nonlocal count
        count += 1
        frame = spark.createDataFrame([(a, BASE + t * SECOND, count * 100 + i, 10, c) for i, (a, t, c) in enumerate(rows)], schema)
        frame.coalesce(1).write.mode("append").parquet(folder)

    def stream(watermark="10 seconds"):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        return rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", watermark)

    return put, stream


def watched(stream):
    """Output rows, and how many states are left at the end."""
    spark, out = stream.sparkSession, []
    query = stream.writeStream.foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination()
    left = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]
    assert spark is not None
    return sorted(out, key=str), left


def test_cooldown_forgets(feed):
    put, stream = feed
    put(("a", 0, False), ("a", 5, False), ("b", 1, False))
    put(("a", 50, False))
    put(("z", 10_000, False))
    out, left = watched(st.cooldown(stream(), ["src"], 30))
    assert [x[0] for x in out] == [100, 102, 200, 300] and left == 1  # z alone


def test_rate_limit_forgets(feed):
    put, stream = feed
    put(*[("a", t, False) for t in range(4)])
    put(("a", 4, False), ("a", 70, False))
    put(("z", 10_000, False))
    out, left = watched(st.rate_limited(stream(), "src", 3, 60))
    assert [x[0] for x in out] == [103, 200] and left == 1


def test_calls_that_never_finish(feed):
    put, stream = feed
    put(("a", 0, False), ("b", 1, False), ("b", 2, True))
    put(("c", 3, False), ("a", 100, True))
    put(("z", 10_000, True))
    out, left = watched(st.call_sessions(stream(), ["src"], 60))
    assert [(k, (a - BASE) // SECOND, (b - BASE) // SECOND, *rest) for k, a, b, *rest in out] == [("a", 0, 0, 1, 10, False), ("a", 100, 100, 1, 10, True), ("b", 1, 2, 2, 20, True), ("c", 3, 3, 1, 10, False), ("z", 10_000, 10_000, 1, 10, True)]
    assert left == 0


def test_first_seen_forgets(feed):
    put, stream = feed
    put(("a", 0, False), ("a", 1, False), ("b", 2, False))
    put(("a", 3, False))
    put(("z", 10_000, False))
    out, left = watched(st.first_seen(stream().select("src", "at"), "src").select("src"))
    assert out == [("a",), ("b",), ("z",)] and left == 1


def test_silence(feed):
    put, stream = feed
    put(("a", 0, False), ("b", 0, False))
    put(("a", 90, False), ("b", 10, False))
    put(("z", 10_000, False))
    out, left = watched(st.silent(stream(), "src", 60))
    assert [(k, (t - BASE) // SECOND) for k, t in out] == [("a", 0), ("a", 90), ("b", 10)] and left == 1


def test_stop(feed):
    put, stream = feed
    put(("a", 0, False), ("a", 1, False), ("b", 0, False))
    put(("a", 2, False), ("b", 500, False), ("b", 501, False))
    out, _ = watched(st.stop_stream(stream(), "src", packets=2, seconds=60))
    assert [x[0] for x in out] == [100, 101, 102]


def test_live_scores_go_on_over_batches_and_forget(feed):
    put, stream = feed
    put(("a", 0, False), ("a", 1, True), ("b", 2, False))
    put(("a", 3, True), ("a", 4, False))
    put(("z", 10_000, False))
    put(("a", 20_000, False))
    rows = stream().withColumns({"hour": F.lit(12), "weekday": F.lit(1), "dst": F.col("closes").cast("string"), "length": F.when(F.col("closes"), 30).otherwise(F.col("length"))})
    with st.settings(rows.sparkSession, st.MANY_STATES):
        out, left = watched(st.live_scores(rows, "src", 60))
    # The second packet of a: three times the mean and the highest before, first contact; its fourth is known and ordinary.
    assert out == [(100, "", 0.0), (101, "CONNECTIONS,FIRST_CONTACT,VOLUME", 100.0), (102, "", 0.0), (200, "", 0.0), (201, "", 0.0), (300, "", 0.0), (400, "", 0.0)] and left <= 10  # entries and timers of at most two hosts


def test_live_scores_of_a_scanner(feed):
    """A host with many destinations: a later batch writes the entries of its own rows only."""
    put, stream = feed
    put(*[("a", t, False) for t in range(2000)])
    put(("a", 2000, False), ("a", 2001, False))
    rows = stream().withColumns({"hour": F.lit(12), "weekday": F.lit(1), "dst": F.when(F.col("us") == BASE + 2001 * SECOND, "0").otherwise(F.col("us") / SECOND - BASE / SECOND).cast("int").cast("string")})
    query_rows = []
    with st.settings(rows.sparkSession, st.MANY_STATES):
        query = st.live_scores(rows, "src", 86_400).writeStream.foreachBatch(lambda batch, _: query_rows.extend(map(tuple, batch.collect()))).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sum(r[1] == "FIRST_CONTACT" for r in query_rows) == 2000  # all but the first packet and the last, whose destination is known
    last = [p for p in query.recentProgress if p["numInputRows"] == 2][-1]["stateOperators"][0]
    assert last["numRowsTotal"] > 2000 and last["numRowsUpdated"] + last["numRowsRemoved"] < 20


def test_late_rows_are_counted(feed):
    put, stream = feed
    put(("a", 0, False), ("a", 1000, False))
    put(("a", 1001, False))
    put(("a", 5, False), ("a", 6, False), ("a", 995, False))
    rows = stream()
    late = st.LateRows()
    rows.sparkSession.streams.addListener(late)
    try:
        out, _ = watched(st.cooldown(rows, ["seq"], 1))
        deadline = time.time() + 30
        while sum(late.dropped.values()) < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        rows.sparkSession.streams.removeListener(late)
    assert sorted(x[0] for x in out) == [100, 101, 200, 302] and sum(late.dropped.values()) == 2


def test_each_request_has_one_response(feed):
    """By id the oldest first, then the newest that waits, over batches; a request beyond the time waits no more, and no state is left."""
    put, stream = feed
    # closes stands for a response; the id is told by the second letter of src.
    put(("ax", 0, False), ("ax", 1, False), ("a-", 2, False))
    put(("ax", 3, True), ("a-", 4, True), ("a-", 5, True), ("a-", 6, True), ("ay", 7, True))
    put(("b-", 100, False), ("b-", 170, True))
    put(("zz", 10_000, False))
    put(("zz", 20_000, False))
    messages = stream().selectExpr("substr(src, 1, 1) as src", "us", "seq", "at", "not closes as is_request", "nullif(substr(src, 2, 1), '-') as id")
    out, left = watched(st.stream_pairs(messages, ["src"], 60))
    assert sorted(out, key=lambda r: r[1]) == [(100, 200, 0.95, "header"), (102, 201, 0.6, "timing"), (101, 202, 0.6, "timing"), (None, 204, 0.5, "orphan")] and left <= 1


def test_many_keys_share_a_group(feed):
    """Keys share calls of Python and their state rows; timers of keys without rows come due beside rows of others."""
    put, stream = feed
    put(*[(f"k{i}", i % 50, False) for i in range(9000)])
    put(*[(f"k{i}", 60, True) for i in range(0, 9000, 2)])
    put(("z", 10_000, False))
    out, left = watched(st.call_sessions(stream(), ["src"], 3600))
    assert [r for r in out if r[5]] == sorted(((f"k{i}", BASE + i % 50 * SECOND, BASE + 60 * SECOND, 2, 20, True) for i in range(0, 9000, 2)), key=str)
    assert len(out) == 9000 and left == 1
    query = st.cooldown(stream("1 day"), ["src"], 86_400).writeStream.foreachBatch(lambda batch, _: [*batch.collect()]).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"] <= st.GROUPS


def test_many_requests_wait(spark, monkeypatch):
    """A row costs the same however many requests of its key wait."""
    steps = []
    monkeypatch.setattr(st, "stateful", lambda *args: steps.append(args[4]))
    st.stream_pairs(None, ["src"], 10)
    n = 40_000
    began = time.time()
    for ids, want in (([f"i{k}" for k in range(n)], range(n)), ([None] * n, range(n - 1, -1, -1))):
        out, state = steps[0](("a",), {"us": list(range(2 * n)), "seq": list(range(2 * n)), "is_request": [True] * n + [False] * n, "id": ids * 2}, None)
        assert state is None and [(r[0], r[1]) for r in out] == list(zip(want, range(n, 2 * n)))
    assert time.time() - began < 10


def test_a_capture_holds_what_may_pass(feed, monkeypatch):
    """Of a batch a task holds the rows that may still pass, in whatever order the rows come."""
    put, stream = feed
    times = [(i * 7919) % 3000 for i in range(3000)]
    put(*[("ab"[i % 2], t, False) for i, t in enumerate(times)])
    put(("a", 4000, False), ("b", 4001, False), ("c", 4002, False))
    held = []
    plain = st.stateful
    monkeypatch.setattr(st, "stateful", lambda *args: held.append(args[7]) or plain(*args))
    monkeypatch.setattr(st, "HELD_ROWS", 20)
    monkeypatch.setattr(st, "GROUPS", 1)
    with st.settings(stream().sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "50"}):
        for limits in ({"packets": 200}, {"seconds": 100}, {"packets": 30, "seconds": 100}, {"byte_limit": 500}, {"packets": 2000}):
            out, _ = watched(st.stop_stream(stream(), "src", **limits))
            want = []
            for k in "ab":
                mine = sorted((t, 100 + i) for i, t in enumerate(times) if "ab"[i % 2] == k)
                mine += [(4000, 200)] if k == "a" else [(4001, 201)]
                want += [s for n, (t, s) in enumerate(mine) if n < limits.get("packets", 9e9) and t - mine[0][0] <= limits.get("seconds", 9e9) and 10 * n < limits.get("byte_limit", 9e9)]
            assert sorted(x[0] for x in out) == sorted([*want, 202]), limits
    rows = pd.DataFrame({"src": ["a", "b"] * 500, "us": range(1000), "seq": range(1000), "length": 10})
    assert len(held[0](rows)) == 2 * 201
    assert len(held[1](rows.assign(us=rows["us"] * SECOND))) == 2 * 52


def test_a_new_host_is_not_looked_up():
    """State calls cross a socket: for a host of which nothing is kept none of its entries is asked for."""
    asked = []

    class Kept:
        def get(self):
            return None

        def getValue(self, key):
            asked.append(key)

        def containsKey(self, key):
            asked.append(key)
            return False

        def update(self, *_):
            pass

        updateValue = registerTimer = update

    scores = st.HostScores(60 * SECOND)
    scores.handle = scores.sums = scores.slots = scores.known = Kept()
    rows = pd.DataFrame({"us": range(100), "seq": range(100), "length": 10, "hour": 12, "slot": [i % 24 for i in range(100)], "peer": [i % 40 for i in range(100)]})
    out = pd.concat(scores.handleInputRows(("a",), iter([rows]), None))
    assert not asked and (out["reasons"] == "FIRST_CONTACT").sum() == 39
