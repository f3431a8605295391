"""All registered queries of the library and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anomalies, basic, edges, fleet, relations, sessions, traffic

BOOKS = [module.BOOK for module in (anomalies, basic, edges, fleet, relations, sessions, traffic)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _book in BOOKS:
    QUERIES |= _book.queries
    ORACLES |= _book.oracles
