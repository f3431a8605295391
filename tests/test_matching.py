"""Rules with open fields, lists of words and windows over the last rows against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.operators import detect, filters, joins, matching, stats


def _some(values, rng):
    return rng.choice([None, *values])


@pytest.mark.parametrize("limit", [100_000, 0])
def test_rules_meet_rows_by_pattern(spark, limit):
    rng = random.Random(5)
    rows = [(i, _some("ab", rng), _some([1, 2, 3], rng)) for i in range(200)] + [(7, "a", 1)]
    rules = [(i, _some("ab", rng), _some([1, 2, 9], rng)) for i in range(25)]
    e, r = spark.createDataFrame(rows, "seq int, kind string, port int"), spark.createDataFrame(rules, "rule_id int, kind string, port int")
    got = sorted((x.seq, x.rule_id) for x in matching.by_pattern(e, r, {"kind": "kind", "port": "port"}, ["rule_id"], limit).collect())
    assert got == sorted((s, i) for s, k, p in rows for i, rk, rp in rules if rk in (None, k) and rp in (None, p))
    assert matching.by_pattern(e, r.limit(0), {"kind": "kind", "port": "port"}, ["rule_id"], limit).count() == 0
    assert filters.match_rules(e.limit(0), r.withColumn("enabled", F.lit(True)), ("kind", "port")).count() == 0


@pytest.mark.parametrize("limit", [100_000, 0])
def test_texts_that_hold_listed_words(spark, limit):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("ab \nü😀") for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(80)] + [(None, "aabbaabb"), (3, "bbbbbbbb"), (4, None)]
    words = sorted({"".join(rng.choice("ab \nü😀") for _ in range(rng.choice([0, 1, 2, 6, 7]))) for _ in range(40)}) + [None]
    t, w = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in words + words[:3]], "words string")
    got = sorted((str(x.id), x.text, x.words) for x in matching.holding(t, "id", F.col("text"), w, F.col("words"), limit).collect())
    assert got == sorted((str(i), x, y) for i, x in texts for y in words if x is not None and y is not None and y in x)


def test_rules_without_fields_are_found_by_content(spark):
    rows = spark.createDataFrame([(1, "TCP", "a", "b", 80, "evil item"), (2, "UDP", None, None, None, None)], "seq int, protocol string, src string, dst string, dport int, summary string")
    rules = spark.createDataFrame([(1, None, None, None, None, "item"), (2, None, None, None, None, None), (3, "TCP", None, None, None, "evil"), (4, None, None, None, 80, "no")], "sid int, protocol string, src_ip string, dst_ip string, dst_port int, content string")
    assert sorted((r.seq, r.sid) for r in joins.ids_matches(rows, rules).collect()) == [(1, 1), (1, 2), (1, 3), (2, 2)]


def test_sizes_are_counted_in_rows_and_bytes(spark):
    one = spark.createDataFrame([("x" * 1000,), (None,)], "v string")
    assert matching.is_small(one) and not matching.is_small(one, rows=1) and not matching.is_small(one, size=500) and matching.is_small(one.limit(0))


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_last_rows_over_blocks(spark, span):
    rng = random.Random(8)
    data = [(b, rng.randrange(100)) for b in sorted(rng.sample(range(-500, 500), 90))]
    frame = spark.createDataFrame(data, "bucket long, n long").repartition(3)
    got = [(r.bucket, r.n, r.size, round(r.mean, 9)) for r in stats.over_last(frame, "bucket", 5, {"size": F.count("*"), "mean": F.avg("n")}, span).orderBy("bucket").collect()]
    want = []
    for i, (b, n) in enumerate(data):
        last = [v for _, v in data[max(0, i - 4) : i + 1]]
        want.append((b, n, len(last), round(statistics.fmean(last), 9)))
    assert got == want
    assert stats.over_last(frame.limit(0), "bucket", 5, {"size": F.count("*")}, span).count() == 0


def test_signatures_ignore_case(spark):
    rows = spark.createDataFrame([(1, "GET /ETC/passwd")], "seq int, text string")
    marks = spark.createDataFrame([("file", "/etc/Passwd"), ("other", "shadow")], "name string, words string")
    assert [(r.seq, r.name) for r in detect.signature_hits(rows, marks, "text", "seq").collect()] == [(1, "file")]
