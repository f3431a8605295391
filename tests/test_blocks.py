"""Windows by blocks, exact selection, carving, traces, rotation and mergeable aggregates against plain versions."""

import os
import random
import re
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from packetloom.operators import baseline, blocks, detect, flows, hooks, matching, selection, server
from packetloom.plans import catalog
from packetloom.sources import adapters, feeds

from .conftest import DATA


@pytest.fixture(scope="module")
def history(spark):
    """Rows of a hot key, a null key and a few others; times in bursts; some values null, some keys of equal values."""
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice([0, 0, 1, 50, 400_000])
        k = rng.choice(["hot"] * 6 + ["b", None, "flat"])
        rows.append((i, k, t, None if rng.random() < 0.05 else 7.0 if k == "flat" else rng.choice([1.0, 5.5, 1e6 + rng.random()])))
    return rows, spark.createDataFrame(rows, "seq long, k string, us long, x double").withColumns({c: F.lit("clash") for c in ("block", "n", "start", "_v", "home", "centre")})


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 13, 1 << 16])
def test_running_moments(history, size):
    rows, frame = history
    got = {r.seq: (r.mean, r.variance, r.z) for r in baseline.running_z(frame, ["k"], "x", ["us", "seq"], size).collect()}
    for part in by_key(rows).values():
        seen = []
        for seq, k, _, x in part:
            seen += [] if x is None else [x]
            mean, variance = (statistics.fmean(seen) if seen else None), (statistics.variance(seen) if len(seen) > 1 else 0.0)
            assert got[seq][0] == (mean if mean is None else pytest.approx(mean, rel=1e-9)) and got[seq][1] == pytest.approx(variance, rel=1e-6, abs=1e-9)
            assert k != "flat" or got[seq][1] == 0.0
    assert len(got) == len(rows)


@pytest.mark.parametrize("size", [1, 13, 1 << 16])
def test_other_windows(history, size):
    rows, frame = history
    before = {r.seq: r.total for r in blocks.preceding(frame, ["k"], ["us", "seq"], F.coalesce("x", F.lit(0.0)), "total", size).collect()}
    last = {r.seq: (r.c, r.s) for r in blocks.trailing(frame, ["k"], 0.5, {"c": F.count("*"), "s": F.sum("x")}, block_rows=size).collect()}
    mean = {r.seq: r.ewma for r in blocks.ewma(frame, "k", "x", 0.3, ["us", "seq"], size).collect()}
    lines = {(r.k, r.number): r.line for r in server.case_lines(frame, "k", ["us", "seq"], F.col("seq").cast("string"), size).collect()}
    for k, part in by_key(rows).items():
        total, e = 0.0, None
        for i, (seq, _, t, x) in enumerate(part):
            assert before[seq] == pytest.approx(total) and lines[k, i + 1] == str(seq)
            window = [r[3] for r in part if t - 500_000 <= r[2] <= t]
            values = [v for v in window if v is not None]
            assert last[seq] == (len(window), pytest.approx(sum(values)) if values else None)
            total += x or 0.0
            if x is None:
                assert mean[seq] is None
            else:
                e = x if e is None else 0.3 * x + 0.7 * e
                assert mean[seq] == pytest.approx(e)


@pytest.mark.parametrize("size", [200, 1000, 1 << 16])
def test_weighted_means_have_the_bits_of_the_recurrence(spark, size):
    """Blocks whose bounds meet, blocks too short for that, a key of equal values (whose bounds do not meet) and a null key."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 10 < 6 else ("b", "flat", None, "rare")[i % 10 - 6] if i % 10 < 9 or i % 50 == 9 else "b", i * 10 + rng.randrange(9), 0) for i in range(6000)]
    rows = [(i, k, t, 7 if k == "flat" else rng.randrange(1, 2000)) for i, k, t, _ in rows]
    frame = spark.createDataFrame(rows, "seq long, k string, us long, x long")
    got = {r.seq: r.ewma for r in blocks.ewma(frame, "k", "x", 0.3, ["us", "seq"], size).collect()}
    want = {}
    for part in by_key(rows).values():
        e = None
        for seq, _, _, x in part:
            e = float(x) if e is None else 0.3 * x + 0.7 * e
            want[seq] = e
    assert got == want


def test_trailing_windows_do_not_read_their_rows_again(spark):
    """Sums over a sliding frame cost rows times the rows of a window; running sums do not."""
    rows = [(i, "a" if i % 3 else None, t) for i, t in enumerate([0, 0, 1, 9, 10, 10, 11, 12, 19, 20, 21, 30, 31, 45, None, None])]
    frame = spark.createDataFrame(rows, "seq long, k string, us long")
    for seconds in (0, 1e-6, 1e-5):
        out = blocks.trailing(frame, ["k"], seconds, {"c": F.count("*"), "s": F.sum("seq")})
        assert out.columns == ["seq", "k", "us", "c", "s"]
        frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", out._jdf.queryExecution().optimizedPlan().toString())
        assert frames and set(frames) == {"unboundedpreceding$()"}
        span = int(seconds * 1_000_000)
        inside = {i: [j for j, m, u in rows if m == k and (u is t if t is None else u is not None and t - span <= u <= t)] for i, k, t in rows}
        assert {r.seq: (r.c, r.s) for r in out.collect()} == {i: (len(v), sum(v)) for i, v in inside.items()}


@pytest.mark.parametrize("cells", [64, 1024])
def test_places(history, monkeypatch, cells):
    rows, frame = history
    monkeypatch.setattr(selection, "CELLS", cells)
    out = selection.places(frame.select("k", "x"), ["k"], "x", {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).collect()
    want = {k: sorted(r[3] for r in part if r[3] is not None) for k, part in by_key(rows).items()}
    assert {r.k: (r.n, r.low, r.mid, r.top) for r in out} == {k: (len(v), v[0], v[len(v) // 2], v[-1]) for k, v in want.items()}
    assert selection.places(frame.where("false"), ["k"], "x", {"a": lambda n: n * 0}).count() == 0


def test_many_words_without_a_nested_loop(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 9))) for _ in range(20_000)})
    texts = [(i, "".join(rng.choice("abcde") for _ in range(300))) for i in range(40)]
    listed = spark.createDataFrame([(w,) for w in words], "words string")
    found = matching.holding(spark.createDataFrame(texts, "id int, text string"), "id", F.col("text"), listed, F.col("words"))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.id, r.words) for r in found.collect()) == sorted((i, w) for i, t in texts for w in words if w in t)


def test_rules_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "TCP", "mine", 5)], "seq int, protocol string, sid string, pattern int").withColumn("key0", F.lit("k"))
    rules = spark.createDataFrame([("TCP", 77), (None, 78)], "proto string, sid int")
    out = matching.by_pattern(rows, rules, {"proto": "protocol"}, ["sid"])
    assert out.columns == ["seq", "protocol", "pattern", "key0", "sid"]
    assert sorted((r.seq, r.pattern, r.key0, r.sid) for r in out.collect()) == [(1, 5, "k", 77), (1, 5, "k", 78)]


def test_a_source_fires_again(spark):
    rows = [(i, "a", t * 1_000_000, s) for i, (t, s) in enumerate([(0, "x"), (1, "y"), (2, "y"), (3, "x"), (20, "z"), (21, "x"), (22, "y")])]
    frame = spark.createDataFrame(rows, "seq long, src string, us long, summary string")
    assert [r.seq for r in detect.correlations(frame, ["x", "y"], cooldown=0).orderBy("seq").collect()] == [1, 3, 6]
    # Within the cooldown nothing fires, and what was seen stays: the next row that shows a word may fire.
    assert [r.seq for r in detect.correlations(frame, ["x", "y"], cooldown=10).orderBy("seq").collect()] == [1, 5]


def test_deep_traces(spark):
    spans = [("t", str(i), str(i - 1) if i else None, i, i + 1) for i in range(1000)] + [("u", "0", "gone", 5, None)]
    frame = spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string, start_ms long, end_ms long")
    assert {(r.trace_id, r.span_id): r.depth for r in flows.traces(frame).collect()} == {("t", str(i)): i for i in range(1000)} | {("u", "0"): 0}
    loop = spark.createDataFrame([("t", "a", "b", 0, 1), ("t", "b", "a", 0, 1)], frame.schema)
    with pytest.raises(ValueError, match="ancestors"):
        flows.traces(loop)


def plain_files(raw):
    """The files of a stream: from the left, past each file that has a size."""
    out, at = [], 0
    while at < len(raw):
        kind = next((k for k, m in flows.MAGICS if raw.startswith(bytes.fromhex(m), at)), None)
        size = None
        if kind in ("jpeg", "png"):
            mark, more, head = (b"\xff\xd9", 0, 3) if kind == "jpeg" else (b"IEND", 4, 8)
            end = raw.find(mark, at + head)
            size = (len(raw) if end < 0 else min(len(raw), end + len(mark) + more)) - at
        if kind and (size is None or size <= flows.FILE_BYTES):
            out.append((kind, at, size))
            at += size or 1
        else:
            at += 1
    return out


@pytest.mark.parametrize("piece", [16, 64, 1 << 16])
def test_carving(spark, piece):
    jpeg, png = b"\xff\xd8\xff\xe0" + b"j" * 40 + b"\xff\xd9", bytes.fromhex("89504E470D0A1A0A") + b"p" * 30 + b"IEND\x01\x02\x03\x04"
    streams = {
        "two": b"aa" + jpeg + b"between" + jpeg + png, "odd": bytes.fromhex("0FFD8FF0FFD8FFE0"), "open": b"x" + jpeg[:-2], "inside": jpeg[:20] + jpeg + b"%PDF-1PK\x03\x04\x7fELF",
        "lap": b"\xff\xd8\xff\xd8\xff" + b"q" * 9, "none": b"plain text" * 30,
    }
    rng, rows = random.Random(3), []
    for name, raw in streams.items():
        at = 0
        while at < len(raw):
            n = rng.randint(1, 9)
            rows += [(name, 1000 + at, 1, bytearray(b"old" * 3)), (name, 1000 + at, 2, bytearray(raw[at : at + n]))]
            at += n
    frame = spark.createDataFrame(rows, "flow string, tcp_seq long, seq long, data binary")
    segments = flows.stream_segments(frame, ["flow"], block_rows=5)
    found = {}
    for r in flows.carve(segments, ["flow"], piece).collect():
        found.setdefault(r.flow, []).append((r.file_kind, r.file_offset, r.file_size))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in found.items()} == {k: plain_files(v) for k, v in streams.items() if plain_files(v)}
    census = flows.magic_census(spark.createDataFrame([("s", bytearray(streams["two"]), 1), ("o", bytearray(streams["odd"]), 2), ("n", None, 3)], "name string, data binary, begin int").drop("begin"))
    assert sorted((r.name, r.file_kind, r.file_offset) for r in census.collect()) == [("o", "jpeg", 4), ("s", "jpeg", 2), ("s", "jpeg", 55), ("s", "png", 101)]


def test_rotation_by_bytes(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    lines = [(i, "l" * (i % 37)) for i in range(2000)]
    frame = spark.createDataFrame(lines, "n long, value string")
    feeds.write_by_bytes(frame, folder, ["n"], 5000, block_rows=64)
    sizes = {d: sum(os.path.getsize(f"{folder}/{d}/{f}") for f in os.listdir(f"{folder}/{d}") if f.endswith(".txt")) for d in sorted(os.listdir(folder), key=lambda d: int(d[5:]) if d.startswith("file=") else -1) if d.startswith("file=")}
    assert all(abs(v - 5000) <= 500 for v in list(sizes.values())[:-1]) and sum(sizes.values()) == sum(len(x) + 1 for _, x in lines)
    feeds.write_by_bytes(frame, folder, ["n"], 5000, newest=3, block_rows=64)
    last = 2 * len(sizes) - 1
    assert sorted(int(d[5:]) for d in os.listdir(folder) if d.startswith("file=")) == [last - 2, last - 1, last]
    feeds.write_by_bytes(frame.limit(0), folder, ["n"], 5000, newest=3)
    assert len([d for d in os.listdir(folder) if d.startswith("file=")]) == 3


def test_aggregate_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hooks, "HELD_KEYS", 3)
    rows = [(i % 7 if i % 7 else None, "x" if i % 2 else None, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b string, v long").repartition(5)
    out = hooks.aggregate_states(frame, ["a", "b"], ["v"], "n long, top long", lambda: (0, -1), lambda s, v: (s[0] + 1, max(s[1], v)), lambda s, t: (s[0] + t[0], max(s[1], t[1])), lambda s: s)
    want = {}
    for a, b, v in rows:
        n, top = want.get((a, b), (0, -1))
        want[a, b] = (n + 1, max(top, v))
    assert {(r.a, r.b): (r.n, r.top) for r in out.collect()} == want
    assert hooks.aggregate_states(frame.where("false"), ["a"], ["v"], "n long", int, lambda s, v: s + 1, lambda s, t: s + t, lambda s: (s,)).count() == 0


@pytest.mark.parametrize("size", [7, 200])
def test_host_scores_by_blocks(spark, duck, size):
    """Many blocks a source give the rows of the SQL; input columns with the names of its own are kept apart or replaced."""
    rows = adapters.packets(spark, DATA).withColumns({c: F.lit("clash") for c in ("block", "n", "top", "first", "n_start", "score")})
    out = baseline.host_scores(rows, block_rows=size)
    assert {"block", "n", "top", "first", "n_start", "score"} <= set(out.columns) and out.columns.count("score") == 1
    got = {r.seq: (r.reasons, r.score) for r in out.select("seq", F.array_join("reasons", ",").alias("reasons"), F.round("score", 5).alias("score")).collect()}
    cursor = duck.execute(catalog.ORACLES["bas06_host_scores"])
    at = [[c[0] for c in cursor.description].index(c) for c in ("seq", "reasons", "score")]
    want = {r[at[0]]: (r[at[1]], pytest.approx(r[at[2]])) for r in cursor.fetchall()}
    assert got == want and len({k for k, _ in got.values()}) > 2


def test_host_scores_of_odd_rows(spark):
    """Null lengths count as packets but not as lengths; null sources and destinations are values like others; no rows, no scores."""
    fields = "seq long, src string, dst string, us long, length long, weekday int, hour int"
    rows = [(1, None, None, 0, None, 1, 12), (2, None, None, 1, 10, 1, 12), (3, None, "a", 2, 30, 1, 12), (4, "x", "a", 2, 5, 1, 3), (5, "x", "a", 3, None, 1, 3)]
    got = {r.seq: (list(r.reasons), r.score) for r in baseline.host_scores(spark.createDataFrame(rows, fields), block_rows=1).collect()}
    assert got == {1: ([], 0.0), 2: ([], 0.0), 3: (["CONNECTIONS", "FIRST_CONTACT", "VOLUME"], 100.0), 4: ([], 0.0), 5: (["OFF_HOURS"], 62.5)}
    assert baseline.host_scores(spark.createDataFrame([], fields)).collect() == []
