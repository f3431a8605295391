"""Baselines, entity behaviour and triage: window frames over each key's own history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, filters


def running_z(rows: DataFrame, keys: list[str], value: str, order: list[str], block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Adds mean, variance (sample; 0 below two rows) and z (0 without spread) of all rows of the key up to this one."""
    out = blocks.running_moments(rows, keys, value, order, block_rows)
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col(value) - F.col("mean")) / F.sqrt("variance")).otherwise(0.0))


def slot(weekday: str = "weekday", hour: str = "hour"):
    """One of 168 slots of the week, Monday first."""
    return F.col(weekday) * 24 + F.col(hour)


def seasonal_z(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return running_z(rows.withColumn("slot", slot()), [*keys, "slot"], value, order)


def packet_outliers(rows: DataFrame, keys: list[str], order: list[str], entropy: str = "entropy", limit: float = 3.5, high_entropy: float = 7.5) -> DataFrame:
    """Adds reason: GLOBAL or SEASONAL (z beyond the limit, this row included), ENTROPY (> 7.5 and longer than 256), else null."""
    g = running_z(rows, keys, "length", order).withColumnRenamed("z", "global_z").drop("mean", "variance")
    s = seasonal_z(g, keys, "length", order).withColumnRenamed("z", "seasonal_z").drop("mean", "variance", "slot")
    return s.withColumn("reason", F.when(F.abs("global_z") > limit, "GLOBAL").when(F.abs("seasonal_z") > limit, "SEASONAL").when((F.col(entropy) > high_entropy) & (F.col("length") > 256), "ENTROPY"))


def sliding_totals(rows: DataFrame, keys: list[str], seconds: int, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Adds packets and bytes of the last so many seconds of the key, this row's instant included."""
    return blocks.trailing(rows, keys, seconds, {"window_packets": F.count("*"), "window_bytes": F.sum("length")}, block_rows=block_rows)


def host_scores(rows: DataFrame, sensor: str | None = None, time: str = "us", order: str = "seq", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Scores each packet against the rows of its source before it.

    Deviations: CONNECTIONS (length over the source's mean: ratio >= 2 or z > 3), OFF_HOURS (not 6-21 h, slot empty or its mean below 50),
    FIRST_CONTACT (destination new to a source that has history), VOLUME (>= 2 x the highest before). score = clamp(15 max + 10 reasons,
    10, 100), 0 without a reason. With a sensor column each sensor has baselines of its own. A source's rows are dealt in blocks of time; a
    destination is known from the first row on that has it. Input columns called mean or variance, reasons or score are replaced.
    """
    keys = [*([sensor] if sensor else []), "src"]
    rows = rows.drop("reasons", "score", "mean", "variance")
    block, n, lengths, total, top, week, in_slot, of_slot, first = names = blocks.unused(rows, "block", "n", "lengths", "total", "top", "week", "in_slot", "of_slot", "first")
    x, at = F.col("length"), F.struct(time, order)
    counted = F.when(x.isNotNull(), 1).otherwise(0)
    dealt, _ = blocks.with_blocks(rows.withColumn(week, slot()), time, block, block_rows)
    h = blocks.sums_before(dealt, keys, block, [time, order], {n: F.lit(1), lengths: counted, total: x}, {top: x})
    h = blocks.sums_before(h, [*keys, week], block, [time, order], {in_slot: counted, of_slot: x})
    h = blocks.moments(h, keys, block, "length", [time, order], -1)
    h = blocks.join_on(h, rows.groupBy(*keys, "dst").agg(F.min(at).alias(first)), [*keys, "dst"], [first])
    mean = F.when(F.col(lengths) > 0, F.try_divide(F.col(total), F.col(lengths)))
    ratio = F.try_divide(x, mean)
    z = F.when(F.col("variance") > 0, (x - mean) / F.sqrt("variance")).otherwise(0.0)
    off = ~F.col("hour").between(6, 21) & ((F.col(in_slot) == 0) | (F.try_divide(F.col(of_slot), F.col(in_slot)) < 50))
    rules = (
        ("CONNECTIONS", filters.two_valued((ratio >= 2) | (z > 3)), F.greatest(ratio, z)),
        ("OFF_HOURS", (F.col(n) > 0) & off, F.lit(3.5)),
        ("FIRST_CONTACT", (F.col(n) > 0) & (at == F.col(first)), F.lit(3.0)),
        ("VOLUME", filters.two_valued((F.col(top) > 0) & (x >= 2 * F.col(top))), 2 * F.try_divide(x, F.col(top))),
    )
    h = h.withColumn("reasons", F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond, _ in rules))))
    worst = F.greatest(F.lit(0.0), *(F.when(cond, v).otherwise(0.0) for _, cond, v in rules))
    score = F.when(F.size("reasons") > 0, F.least(F.lit(100.0), F.greatest(F.lit(10.0), 15 * worst + 10 * F.size("reasons")))).otherwise(0.0)
    return h.withColumn("score", score).drop(*names, "mean", "variance")


def distinct_counts(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Active sources, destinations and ports; approximate for very large inputs."""
    n = F.approx_count_distinct if approximate else F.countDistinct
    return rows.agg(n("src").alias("sources"), n("dst").alias("destinations"), n("dport").alias("ports"))


def entity_profiles(rows: DataFrame) -> DataFrame:
    """Per address, from both roles: activity by hour (24 counts), bytes in and out, distinct destinations and ports, packets.

    Both roles come from one scan; partial sums are made before the shuffle. Hours are counted as 24 conditional sums."""
    role = F.explode(F.array(F.struct(F.col("src").alias("entity"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("entity"), F.lit(False).alias("out"))))
    r = rows.select("dst", "dport", "length", "hour", role.alias("r")).select("*", "r.*")
    return r.groupBy("entity").agg(
        F.array(*(F.count_if(F.col("out") & (F.col("hour") == h)) for h in range(24))).alias("activity"),
        F.sum(F.when(F.col("out"), F.col("length")).otherwise(0)).alias("bytes_out"),
        F.sum(F.when(F.col("out"), 0).otherwise(F.col("length"))).alias("bytes_in"),
        F.countDistinct(F.when(F.col("out"), F.col("dst"))).alias("destinations"),
        F.countDistinct(F.when(F.col("out"), F.col("dport"))).alias("ports"),
        F.count_if("out").alias("packets"),
    )


def entity_evaluation(profiles: DataFrame, threshold: int = 10 << 20, fan_out: int = 50) -> DataFrame:
    """Adds off_hours, exfiltration, fan_out (severities, 0 if not flagged), score (their maximum) and suspicious (score >= 50)."""
    quiet = sum((F.col("activity")[h] for h in (22, 23, 0, 1, 2, 3, 4, 5)), F.lit(0))
    share = F.when(F.col("packets") > 0, quiet / F.col("packets")).otherwise(0.0)
    ratio = F.when(F.col("bytes_in") > 0, F.col("bytes_out") / F.col("bytes_in")).otherwise(10.0)
    out = profiles.withColumns(
        {
            "off_hours": F.when((share > 0.2) & (F.col("packets") > 5), F.least(100 * share, F.lit(90.0))).otherwise(0.0),
            "exfiltration": F.when((F.col("bytes_out") > threshold) & (ratio > 3), F.least(50.0 * F.col("bytes_out") / threshold, F.lit(95.0))).otherwise(0.0),
            "fan_out": F.when(F.col("destinations") > fan_out, F.least(40.0 * F.col("destinations") / fan_out, F.lit(85.0))).otherwise(0.0),
        }
    )
    return out.withColumn("score", F.greatest("off_hours", "exfiltration", "fan_out")).withColumn("suspicious", F.col("score") >= 50)


# Ports that raise a triage score.
SENSITIVE_PORTS = (22, 23, 135, 139, 445, 1433, 3306, 3389, 5900)


def connection_features(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "src", "dst", "dport", "length", F.col("dport").isin(*SENSITIVE_PORTS).alias("sensitive_port"), (filters.tcp_flag("rst", "eq", 1) & filters.tcp_flag("ack", "eq", 0)).alias("bare_reset"))


def triage(features: DataFrame, has_alert: str = "has_alert", entropy: str = "entropy") -> DataFrame:
    """Adds score (+40 alert, +15 sensitive port, +25 entropy > 7.5 and longer than 200, +10 reset without ACK) and band by 20/45/70/89."""
    score = F.when(F.col(has_alert), 40).otherwise(0) + F.when(F.col("sensitive_port"), 15).otherwise(0) + F.when((F.col(entropy) > 7.5) & (F.col("length") > 200), 25).otherwise(0) + F.when(F.col("bare_reset"), 10).otherwise(0)
    out = features.withColumn("score", score)
    s = F.col("score")
    return out.withColumn("band", F.when(s <= 20, "info").when(s <= 45, "low").when(s <= 70, "medium").when(s <= 89, "high").otherwise("critical"))
