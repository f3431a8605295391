"""Windows over long histories. Rows of a key are dealt in blocks of the first column of their order (a time, a sequence number); what a block
needs of the blocks before it is a few sums, so that a key that holds most rows is spread over as many tasks as it has blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import folds

#: Rows that a block would hold if rows were spread evenly.
BLOCK_ROWS = 1 << 16
#: Rows (over alpha) from which bounds of a weighted mean may be expected to meet; values beyond the bound are not tried.
MEETING_ROWS, BOUND = 50, 1e300


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have yet, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_blocks(rows: DataFrame, first: str, name: str, block_rows: int = BLOCK_ROWS, least: int = 1) -> tuple[DataFrame, int]:
    """Adds the number of a row's block, and returns the width of a block: the span of the first column is cut evenly, `least` at least."""
    n, low, high = rows.agg(F.count(first), F.min(first), F.max(first)).first()
    width = max(least, -(-(high - low + 1) * block_rows // n)) if n else least
    return rows.withColumn(name, F.floor(F.col(first) / width)), width


def join_on(left: DataFrame, right: DataFrame, keys: list[str], added: list[str]) -> DataFrame:
    """left with columns of right, whose keys are unique; null is a key like any other. A left row without a partner goes."""
    same = reduce(lambda a, b: a & b, (F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys), F.lit(True))
    return left.alias("l").join(right.alias("r"), same).select("l.*", *(F.col(f"r.`{c}`") for c in added))


def sums_before(dealt: DataFrame, keys: list[str], block: str, order: list[str], sums: dict[str, Column], tops: dict[str, Column] | None = None) -> DataFrame:
    """Adds, of the rows of the key before each row, sums (0 without rows) and highest values (null without), from rows dealt in blocks."""
    tops = tops or {}
    start = dict(zip([*sums, *tops], unused(dealt, *(f"{n}_start" for n in (*sums, *tops)))))
    of_block = dealt.groupBy(*keys, block).agg(*(F.sum(e).alias(start[n]) for n, e in sums.items()), *(F.max(e).alias(start[n]) for n, e in tops.items()))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = of_block.withColumns({start[n]: F.sum(start[n]).over(earlier) for n in sums} | {start[n]: F.max(start[n]).over(earlier) for n in tops})
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_on(dealt, starts, [*keys, block], list(start.values()))
    zero = F.lit(0)
    added = {n: F.coalesce(F.col(start[n]), zero) + F.coalesce(F.sum(e).over(inside), zero) for n, e in sums.items()}
    added |= {n: F.greatest(F.col(start[n]), F.max(e).over(inside)) for n, e in tops.items()}
    return out.withColumns(added).drop(*start.values())


def preceding(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds name: the sum of amount over the rows of the key before this one."""
    rows = rows.drop(name)
    block, = unused(rows, "block")
    dealt, _ = with_blocks(rows, order[0], block, block_rows)
    return sums_before(dealt, keys, block, order, {name: amount}).drop(block)


def running_moments(rows: DataFrame, keys: list[str], value: str, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds mean and variance (sample; 0 below two values) of a key's values up to each row, this row's included."""
    rows = rows.drop("mean", "variance")
    block, = unused(rows, "block")
    dealt, _ = with_blocks(rows, order[0], block, block_rows)
    return moments(dealt, keys, block, value, order).drop(block)


def moments(dealt: DataFrame, keys: list[str], block: str, value: str, order: list[str], last: int = 0) -> DataFrame:
    """Adds mean and variance of a key's values up to each row (last = -1: up to the row before), from rows dealt in blocks: moments of whole
    blocks, merged, and windows inside a block. Values are measured from the key's mean, so that squares do not cancel; equal values have
    the variance 0 exactly."""
    n, m, q, low, high, centre = names = unused(dealt, "n", "m", "q", "low", "high", "centre")
    x = F.col(value).cast("double")
    of_block = dealt.groupBy(*keys, block).agg(F.count(value).alias(n), F.avg(x).alias(m), F.var_pop(x).alias(q), F.min(x).alias(low), F.max(x).alias(high))
    of_key = Window.partitionBy(*keys)
    of_block = of_block.withColumn(centre, F.sum(F.col(n) * F.col(m)).over(of_key) / F.sum(n).over(of_key))
    before = of_key.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    away = F.col(m) - F.col(centre)
    sums = {n: F.sum(n), m: F.sum(F.col(n) * away), q: F.sum(F.col(n) * (F.col(q) + away * away)), low: F.min(low), high: F.max(high)}
    starts = of_block.withColumns({c: e.over(before) for c, e in sums.items()})
    both = join_on(dealt, starts, [*keys, block], [n, m, q, low, high, centre])
    so_far = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    d = x - F.col(centre)
    inside = {n: F.count(value), m: F.sum(d), q: F.sum(d * d)}
    zero = F.lit(0.0)
    both = both.withColumns({c: F.coalesce(c, zero) + F.coalesce(e.over(so_far), zero) for c, e in inside.items()} | {low: F.least(low, F.min(x).over(so_far)), high: F.greatest(high, F.max(x).over(so_far))})
    spread = (F.col(q) - F.col(m) * F.col(m) / F.col(n)) / (F.col(n) - 1)
    out = both.withColumn("variance", F.when((F.col(n) > 1) & (F.col(low) < F.col(high)), F.greatest(spread, zero)).otherwise(0.0))
    return out.withColumn("mean", F.when(F.col(low) == F.col(high), F.col(low)).when(F.col(n) > 0, F.col(centre) + F.col(m) / F.col(n))).drop(*names)


def trailing(rows: DataFrame, keys: list[str], seconds: float, sums: dict[str, Column], time: str = "us", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds sums or counts over the key's rows of the last so many seconds, this row's instant included. A block is as long as the window,
    whatever block_rows says, so that a window is the beginning of its row's block and the end of the one before. Both are running sums, and
    a row costs the same however many rows its window has. Rows are dealt to the next block too, where their sums are looked up and they go."""
    span = int(seconds * 1_000_000)
    carried, block, place, end, *own = unused(rows, "carried", "block", "place", "end", *(f"{c}_own" for c in sums))
    t, over_here = F.col(time), F.col(carried)
    dealt = rows.withColumn(carried, F.explode(F.when(t.isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = dealt.withColumns({block: F.floor(t / max(1, span)) + over_here.cast("long"), place: t + F.when(over_here, span).otherwise(0)}).repartition(*keys, block)
    in_block = Window.partitionBy(*keys, block)
    # From the block's first instant on, or for carried rows from its last one back.
    running = Window.partitionBy(*keys, block, carried).orderBy(F.when(over_here, -t).otherwise(t)).rangeBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({n: e.over(running) for n, e in zip(own, sums.values())})
    looked_up = F.last(F.when(over_here, F.struct(*own)), ignorenulls=True).over(in_block.orderBy(F.desc(place)).rangeBetween(Window.unboundedPreceding, 0))
    out = summed.withColumn(end, looked_up).where(~over_here)
    both = {c: F.coalesce(F.col(n) + F.col(end)[n], n, F.col(end)[n]) for c, n in zip(sums, own)}
    return out.withColumns(both).drop(carried, block, place, end, *own)


def ewma(rows: DataFrame, key: str, value: str, alpha: float, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ewma: the exponentially weighted mean, seeded by the first value; alpha is held within 0.01 and 0.99; null values leave it out.

    Every mean has the very bits of the recurrence a x + (1 - a) e walked row by row from the key's first value. A step keeps the order of two
    means, rounding too, so that a block walked from bounds of all means whose ends meet ends there for any mean that it begins with. From
    such a block on (with enough rows of a key, nearly each) the rows up to the next such block are walked by themselves; a key with fewer
    rows is walked as a whole."""
    a = min(0.99, max(0.01, alpha))
    rows = rows.drop("ewma")
    block, low, high, n, ends, chain, begin = unused(rows, "block", "low", "high", "n", "ends", "chain", "begin")
    dealt, _ = with_blocks(rows, order[0], block, block_rows)
    dealt = dealt.where(F.col(value).isNotNull())
    x = F.col(value).cast("double")

    def step(mean, x):
        return a * float(x) + (1 - a) * mean

    def from_bounds(state, x, low, high):
        state = tuple(step(m, x) for m in state or (low, high))
        return state, state[0] if state[0] == state[1] else None

    of_block = dealt.groupBy(key, block).agg(F.count("*").alias(n), F.min(x).alias(low), F.max(x).alias(high))
    of_key = Window.partitionBy(key)
    # Rounding may lead a mean a little beyond all values.
    margin = F.greatest(F.abs(F.min(low).over(of_key)), F.abs(F.max(high).over(of_key))) * 1e-9
    of_block = of_block.withColumns({low: F.min(low).over(of_key) - margin, high: F.max(high).over(of_key) + margin})
    enough = of_block.where((F.col(n) >= MEETING_ROWS / a) & F.col(low).between(-BOUND, BOUND) & F.col(high).between(-BOUND, BOUND))
    bounded = join_on(dealt.select(key, block, value, *(c for c in order if c not in (key, value))), enough, [key, block], [low, high])
    met = folds.fold(bounded, [key, block], order, [value, low, high], from_bounds, f"{ends} double")
    last = met.groupBy(key, block).agg(F.max_by(F.struct(ends), F.struct(*order))[ends].alias(ends)).where(F.col(ends).isNotNull())
    same = F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.b") == F.col("r.b"))
    of_block = of_block.select(F.col(key).alias("k"), F.col(block).alias("b")).alias("l").join(last.select(F.col(key).alias("k"), F.col(block).alias("b"), F.col(ends).alias("e")).alias("r"), same, "left").select("l.*", "r.e")
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    chains = of_block.select(F.col("k").alias(key), F.col("b").alias(block), F.count("e").over(before).alias(chain), F.struct(F.last("e", ignorenulls=True).over(before).alias("mean")).alias(begin))

    def from_row(mean, begin, x):
        mean = begin["mean"] if mean is None else mean
        mean = float(x) if mean is None else step(mean, x)
        return mean, mean

    chained = join_on(dealt, chains, [key, block], [chain, begin])
    out = folds.fold(chained, [key, chain], order, [begin, value], from_row, "ewma double").drop(block, chain, begin)
    return out.unionByName(rows.where(F.col(value).isNull()).withColumn("ewma", F.lit(None).cast("double")))
