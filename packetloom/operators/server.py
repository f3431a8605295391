"""Reports and views of the fleet server. Every time of reference is an argument, so that results can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks

HOUR, DAY = 3_600_000_000, 86_400_000_000


def fleet_throughput(latest: DataFrame) -> DataFrame:
    """One row over the latest heartbeat of each sensor."""
    return latest.agg(F.count("*").alias("sensors"), F.sum("bps").alias("bps"))


def throughput_history(heartbeats: DataFrame, sensor: int, as_of_us: int, span_us: int, bucket_us: int) -> DataFrame:
    recent = heartbeats.where((F.col("sensor_id") == sensor) & F.col("us").between(as_of_us - span_us, as_of_us))
    return recent.groupBy(F.floor(F.col("us") / bucket_us).alias("bucket")).agg(F.avg("bps").alias("bps"))


def edges(rows: DataFrame, n: int = 100) -> DataFrame:
    g = rows.groupBy("src", "dst", "protocol").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return g.orderBy(F.desc("n"), "src", "dst", "protocol").limit(n)


def nodes(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(F.col("src").alias("node")).union(edge_rows.select("dst")).distinct()


def newest_page(rows: DataFrame, time: str, tie: str, page: int, size: int) -> DataFrame:
    """A page, newest first; the size is held within 1 and 500, pages count from 1."""
    size = min(500, max(1, size))
    return rows.orderBy(F.desc(time), F.desc(tie)).offset((max(1, page) - 1) * size).limit(size)


def histogram(rows: DataFrame, seconds: int = 3600, time: str = "us") -> DataFrame:
    """Counts per bucket of at least 10 s, named by its start in seconds."""
    size = max(10, seconds)
    return rows.groupBy((F.floor(F.col(time) / (size * 1_000_000)) * size).alias("bucket")).agg(F.count("*").alias("n"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """One row: alerts by status and by severity."""
    return alerts.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == x).alias(x) for x in ("open", "acknowledged", "resolved")), *(F.count_if(F.col("severity") == x).alias(x) for x in ("critical", "high", "medium", "low")))


def events_per_second(rows: DataFrame, as_of_us: int, span_us: int) -> DataFrame:
    """Rows of the last time over the seconds between its first and last; 0 without a span."""
    r = rows.where(F.col("us").between(as_of_us - span_us, as_of_us)).agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("s"))
    return r.select(F.coalesce(F.try_divide("n", "s"), F.lit(0.0)).alias("eps"))


def since(rows: DataFrame, as_of_us: int, span_us: int, time: str) -> DataFrame:
    return rows.where(F.col(time).between(as_of_us - span_us, as_of_us))


def trend_bins(rows: DataFrame, as_of_us: int, bin_us: int, bins: int, time: str) -> DataFrame:
    """The last bins with their counts, empty ones as 0."""
    start = as_of_us - bins * bin_us
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = rows.where((F.col(time) >= start) & (F.col(time) < as_of_us)).groupBy(F.floor((F.col(time) - start) / bin_us).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def top_n(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def repair_times(alerts: DataFrame) -> DataFrame:
    """Mean hours to resolve, and share of acknowledged alerts among all that were looked at; null when undefined."""
    hours = (F.col("resolved_us") - F.col("created_us")) / HOUR
    seen = F.col("status").isin("acknowledged", "resolved")
    return alerts.agg(F.avg(hours).alias("mttr_hours"), F.try_divide(F.count_if(F.col("status") == "acknowledged"), F.count_if(seen)).alias("acknowledged_share"))


def daily_report(alerts: DataFrame, by_severity: DataFrame | None = None) -> DataFrame:
    """One row per day: alerts, resolved, open, sensors, mean hours to resolve."""
    return alerts.groupBy(F.floor(F.col("created_us") / DAY).alias("day")).agg(
        F.count("*").alias("alerts"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "open").alias("open"), F.countDistinct("sensor_id").alias("sensors"), F.avg((F.col("resolved_us") - F.col("created_us")) / HOUR).alias("mttr_hours")
    )


def compliance_scores(alerts: DataFrame, rows: DataFrame, sensors: DataFrame, within_us: int) -> DataFrame:
    """One row: share of resolved alerts that were in time, of encrypted packets, of sensors online; null when undefined."""
    a = alerts.agg(F.avg(F.when(F.col("resolved_us").isNotNull(), (F.col("resolved_us") - F.col("created_us") <= within_us).cast("double"))).alias("in_time"))
    p = rows.agg(F.avg(F.col("protocol").isin("TLS", "SSH", "QUIC").cast("double")).alias("encrypted"))
    s = sensors.agg(F.avg(F.col("online").cast("double")).alias("online"))
    return a.crossJoin(p).crossJoin(s)  # one row each


def custom_report(sections: dict[str, DataFrame], chosen: list[str]) -> DataFrame:
    """(section, name, value) of the chosen sections; each section is a frame of (name, value)."""
    parts = [sections[c].select(F.lit(c).alias("section"), F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value")) for c in chosen]
    return reduce(lambda a, b: a.union(b), parts)


def fleet_summary(latest: DataFrame, as_of_us: int, offline_us: int) -> DataFrame:
    """One row: sensors offline (silent for longer), degraded (drops above 5 % or CPU above 85 %), their throughput and mean drop."""
    state = F.when(F.lit(as_of_us) - F.col("us") > offline_us, "offline").when((F.col("drop_pct") > 5) | (F.col("cpu") > 85), "degraded").otherwise("online")
    return latest.withColumn("_s", state).agg(*(F.count_if(F.col("_s") == x).alias(x) for x in ("online", "degraded", "offline")), F.sum("bps").alias("bps"), F.avg("drop_pct").alias("mean_drop"))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """Rows with the newest change of the column, if there is one: a log of changes instead of updates in place."""
    newest = changes.groupBy(key).agg(F.max_by(column, F.struct(*order)).alias("_new"))
    return rows.join(newest, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Incoming rows replace those of the same key at the next version; new keys start at 1."""
    old = current.select(key, F.col(version).alias("_v"))
    fresh = incoming.join(old, key, "left").withColumn(version, F.coalesce(F.col("_v") + 1, F.lit(1))).drop("_v")
    return current.join(incoming.select(key), key, "left_anti").unionByName(fresh.select(*current.columns))


def version_history(versions: DataFrame, key: str, version: str, back: int | None = None) -> DataFrame:
    """All versions with their place, newest first; back: only the one so many steps back (a rollback's source)."""
    ranked = versions.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version))))
    return ranked if back is None else ranked.where(F.col("place") == back + 1)


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are new are added, each once."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns))


def case_lines(rows: DataFrame, case: str, order: list[str], text: Column, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """(case, number, line): each case's events in order, numbered from 1, a row each; a case of any length is spread over tasks."""
    numbered = blocks.preceding(rows.select(case, *order, text.alias("line")), [case], order, F.lit(1), "number", block_rows)
    return numbered.select(case, (F.col("number") + 1).alias("number"), "line")


def case_story(rows: DataFrame, case: str, time: str, text: Column) -> DataFrame:
    """Per case its events in order as one text; for cases whose story may be long, use case_lines."""
    return rows.groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), text.alias("x")))), lambda e: e["x"]), "; ").alias("story"))


def quality_metrics(alerts: DataFrame) -> DataFrame:
    """Per severity: share of false and true positives, mean hours to resolve, alerts per hour of the span."""
    span = (F.max("created_us") - F.min("created_us")) / HOUR
    return alerts.groupBy("severity").agg((F.count_if(F.col("status") == "acknowledged") / F.count("*")).alias("fp_rate"), (F.count_if(F.col("status") == "resolved") / F.count("*")).alias("tp_rate"), F.avg((F.col("resolved_us") - F.col("created_us")) / HOUR).alias("mttr_hours"), F.try_divide(F.count("*"), span).alias("per_hour"))


# Tactics in their order.
TACTICS = ("Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact")


def tactic_matrix(hits: DataFrame) -> DataFrame:
    """Every tactic in order with its distinct techniques and number of hits. hits: (tactic, technique)."""
    order = hits.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(TACTICS)], "place int, tactic string")
    found = hits.groupBy("tactic").agg(F.array_sort(F.collect_set("technique")).alias("techniques"), F.count("*").alias("hits"))
    return order.join(found, "tactic", "left").select("place", "tactic", F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"), F.coalesce("hits", F.lit(0)).alias("hits"))


def suggestions(rows: DataFrame, column: str, prefix: str, n: int = 10) -> DataFrame:
    return top_n(rows.where(F.col(column).startswith(prefix)), column, n)


def tenant_usage(rows: DataFrame, quotas: DataFrame, tenant: str) -> DataFrame:
    """Use of each tenant against its quota. rows: tenant, sensor, length; quotas: (tenant, max_events, max_sensors, max_bytes)."""
    use = rows.groupBy(tenant).agg(F.count("*").alias("events"), F.countDistinct("sensor").alias("sensors"), F.sum("length").alias("bytes"))
    over = (F.col("events") > F.col("max_events")) | (F.col("sensors") > F.col("max_sensors")) | (F.col("bytes") > F.col("max_bytes"))
    return use.join(quotas, tenant, "left").withColumn("over_quota", F.coalesce(over, F.lit(False))).drop("max_events", "max_sensors", "max_bytes")
