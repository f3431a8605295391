"""Folds over null keys, null values and numbers that a double cannot hold."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from packetloom.operators import blocks, folds, governance

BIG = 2**60 + 1
ROWS = [(BIG, None, 1.5, 0, 10), (BIG + 2, None, 1.5, 1, 20), (None, 7, float("nan"), 5_000_000, 30), (BIG + 6, 7, float("nan"), 5_000_001, 40), (BIG + 8, 7, float("nan"), None, 50), (BIG + 10, 7, None, 90_000_000, None)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "seq long, k long, f double, us long, length long").withColumns({"price": F.lit(Decimal("1.10")), "tags": F.array(F.lit("a")), "at": F.lit("2024-01-01").cast("timestamp")})


def ids(frame):
    return {r.seq for r in frame.collect()}


def test_null_keys_are_one_key(frame):
    assert ids(folds.cooldown(frame, ["k"], 10)) == {BIG, None, BIG + 10}


def test_not_a_number_is_one_key(frame):
    assert ids(folds.cooldown(frame.where("f is not null"), ["f"], 10)) == {BIG, None}


def test_thresholds(frame):
    assert ids(folds.threshold_alerts(frame, ["k"], 2, 10)) == {BIG + 2, BIG + 6}


def test_distinct(frame):
    assert ids(folds.anchored_distinct(frame, "k", "length", 2, 10)) == {BIG + 2, BIG + 6}


@pytest.mark.parametrize(("by", "want"), [("time", {BIG: 0, BIG + 2: 0, None: 0, BIG + 6: 0, BIG + 8: None, BIG + 10: 1}), ("bytes", {BIG: 0, BIG + 2: 0, None: 0, BIG + 6: 1, BIG + 8: 2, BIG + 10: None})])
def test_splits(frame, by, want):
    out = folds.split_greedy(frame.withColumn("place", F.coalesce("us", F.lit(5_000_002))).withColumn("chunk", F.lit("clash")), ["k"], 10 if by == "time" else 40, by, order="place")
    assert {r.seq: r.chunk for r in out.collect()} == want
    assert all(r.price == Decimal("1.10") and r.tags == ["a"] and r["at"].year == 2024 for r in out.collect())


def test_ewma(frame):
    got = {r.seq: r.ewma for r in blocks.ewma(frame, "k", "length", 0.5, ["us", "seq"]).collect()}
    assert got == {BIG: 10.0, BIG + 2: 15.0, BIG + 8: 50.0, None: 40.0, BIG + 6: 40.0, BIG + 10: None}


def test_chains(frame):
    rows = frame.select(F.col("seq").alias("id"), "k", *(F.lit("x").alias(c) for c in ("user_id", "action", "resource", "ip_address")), F.col("us").alias("timestamp_epoch")).where("id is not null")
    chained = governance.chain_entries(rows, "k")
    assert ids(chained.withColumnRenamed("id", "seq")) == {BIG + 2 * n for n in (0, 1, 3, 4, 5)}
    assert governance.verify_chain(chained.where("k is not null"), by="k").count() == 0


def test_empty(frame):
    assert blocks.ewma(frame.where("false"), "k", "length", 0.5, ["us"]).count() == 0
    assert folds.cooldown(frame.where("false"), ["k"], 1).columns == frame.columns
