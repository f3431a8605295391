"""Values at given places of a group's sorted values, exactly, without sorting a group: counts by ranges of values, of which the one that holds
the place is cut again until it is a single value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import settled
from .blocks import join_on

#: Ranges into which a range is cut.
CELLS = 1024


def places(rows: DataFrame, by: list[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, a column for each wanted): n is the number of values of the group, wanted gives 0-based places from it. Nulls do not count;
    values are finite numbers. A round costs a pass over the different values; each task sends CELLS sums a group and place at most."""
    counts = settled(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "values")
    spots = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), place(F.col("n")).cast("long").alias("_place")) for name, place in wanted.items())))
    state = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).withColumn("_s", spots)
    columns = [*by, "n", "_name", "_place", "_low", "_high", "_before"]
    state = settled(state.select(*by, "n", "_s.*", "_low", "_high", F.lit(0).cast("long").alias("_before")).select(columns), "ranges")
    while state.where("_low < _high").limit(1).count():
        inside = join_on(counts, state.where("_low < _high"), by, columns[len(by) :]).where("_v between _low and _high")
        share = (F.col("_v").cast("double") - F.col("_low").cast("double")) / (F.col("_high").cast("double") - F.col("_low").cast("double"))
        cells = inside.withColumn("_cell", F.least(F.lit(CELLS - 1), F.floor(share * CELLS))).groupBy(*by, "n", "_name", "_place", "_before", "_cell")
        cells = cells.agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        earlier = F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("_before", F.col("_before") + F.coalesce(earlier, F.lit(0))).where("_place >= _before and _place < _before + _c")
        state = settled(state.where("_low = _high").unionByName(cells.select(columns)), "ranges")
    return state.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in wanted))
