"""Registered queries against their SQL twins on the smallest tables. A fifth of them by default; ALL_QUERIES=1 runs every one."""

import math
import os

import pytest

from packetloom.plans import catalog

from .conftest import DATA

NAMES = sorted(catalog.ORACLES)
CHOSEN = NAMES if os.environ.get("ALL_QUERIES") else NAMES[::5]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def key(row):
    return [(str(type(v)), str(v)) for v in row]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    order = [columns.index(c) for c in frame.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(plain(v) for v in r) for r in frame.collect()), key=key)
    assert got == want


def test_every_query_is_registered_once():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 290


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["src", "packets", "bytes"] and frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
