"""Joins: indicators, rules, names, assets, detail rows, latest rows, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from . import filters, matching
from .matching import small

def ip_indicators(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """Rows whose source (sid 200001) or destination (sid 200002) is a listed address; one row per match. indicators: (value)."""
    listed = small(indicators.select("value").where("value is not null").distinct())
    source = rows.join(listed, F.col("src") == F.col("value")).withColumn("sid", F.lit(200001))
    return source.unionByName(rows.join(listed, F.col("dst") == F.col("value")).withColumn("sid", F.lit(200002)))


def domain_indicators(rows: DataFrame, indicators: DataFrame, domain: Column) -> DataFrame:
    """Rows whose domain, in lower case, is listed (sid 300001)."""
    listed = indicators.select(F.lower(F.trim("value")).alias("domain")).where("domain <> ''").distinct()
    return rows.withColumn("domain", F.lower(domain)).join(small(listed), "domain").withColumn("sid", F.lit(300001))


def ids_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, sid): rules (sid, protocol, src_ip, dst_ip, dst_port, content), null meaning any, against packets.

    Rules are joined by the pattern of fields that they set. Those that set none but content are looked up by their content."""
    fields = {"protocol": "protocol", "src_ip": "src", "dst_ip": "dst", "dst_port": "dport"}
    only_content = filters.all_of(*(F.col(f).isNull() for f in fields), F.col("content").isNotNull())
    keyed = matching.by_pattern(rows, rules.where(~only_content), fields, ["sid", "content"]).where(F.col("content").isNull() | F.contains("summary", "content")).select(*rows.columns, "sid")
    loose = matching.holding(rows, "seq", F.col("summary"), rules.where(only_content).select("sid", "content"), F.col("content"))
    return keyed.unionByName(loose.select(*rows.columns, "sid"))


def flagged(rows: DataFrame, indicators: DataFrame, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Rows that touch any listed value with any of the columns."""
    listed = small(indicators.select("value").where("value is not null").distinct())
    hit = None
    for c in columns:
        part = rows.join(listed, F.col(c) == F.col("value"), "left_semi")
        hit = part if hit is None else hit.union(part)
    return hit.dropDuplicates(["seq"])


def with_name(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str, alias: str) -> DataFrame:
    """Left join of one name, the first in order where a key has several; rows stay as many as they are."""
    return rows.join(dim.groupBy(F.col(dim_key).alias(key)).agg(F.min(name).alias(alias)), key, "left")


def alert_detail(alerts: DataFrame, rules: DataFrame, events: DataFrame, users: DataFrame) -> DataFrame:
    """Alert with rule, event and the names of its three users, in one plan of left joins. rules: (rule_id, rule_name); events:
    (event_id, event_title); users: (user_id, name)."""
    out = alerts.join(rules, "rule_id", "left").join(events, "event_id", "left")
    for who in ("created_by", "acknowledged_by", "resolved_by"):
        out = out.join(users.select(F.col("user_id").alias(who), F.col("name").alias(f"{who}_name")), who, "left")
    return out


def linked(left: DataFrame, links: DataFrame, left_key: str, link_key: str) -> DataFrame:
    """Rows that a link table ties to a case: left joined through (link_key, case_id)."""
    return left.join(links.select(F.col(link_key).alias(left_key), "case_id").distinct(), left_key)


def latest(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by the order columns; a grouped maximum, not a sort."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def with_latest(dim: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return dim.join(latest(rows, key, order), key, "left")


def asset_impact(rows: DataFrame, assets: DataFrame, ip: str, host: str) -> DataFrame:
    """Asset of the address, else of the host name in lower case, else unknown. assets: (ip, hostname, tier 1-4, department, classification).

    Adds asset, criticality, classification, financial_impact."""
    fields = F.struct("hostname", "tier", "department", "classification")
    by_ip = assets.where("ip is not null").groupBy(F.col("ip").alias(ip)).agg(F.min(fields).alias("_a"))
    by_host = assets.where("hostname is not null").groupBy(F.lower("hostname").alias("_host")).agg(F.min(fields).alias("_b"))
    out = rows.join(small(by_ip), ip, "left").join(small(by_host), F.lower(host) == F.col("_host"), "left")
    a = F.coalesce("_a", "_b")
    return out.withColumns(
        {
            "asset": F.coalesce(a["hostname"], host, ip, F.lit("Unknown-Host")),
            "criticality": F.when(a.isNull(), "UNKNOWN").otherwise(F.concat(F.lit("Tier "), a["tier"].cast("string"), F.lit(" ("), a["department"], F.lit(")"))),
            "classification": F.coalesce(a["classification"], F.lit("INTERNAL")),
            "financial_impact": F.when(a.isNull(), "Medium").when(a["tier"] <= 2, "High").when(a["tier"] == 3, "Medium").otherwise("Low"),
        }
    ).drop("_a", "_b", "_host")


def learned_names(answers: DataFrame) -> DataFrame:
    """(ip, name): the last answer of each address wins. answers: (ip, name, us, seq)."""
    return answers.groupBy("ip").agg(F.max_by("name", F.struct("us", "seq")).alias("name"))


def as_of(rows: DataFrame, facts: DataFrame, key: str, value: str, time: str = "us", tie: str = "seq") -> DataFrame:
    """Adds to each row the value of the latest fact of its key at or before its time; at equal times facts come first.

    Both sides are laid into one order per key and the last known value is carried along; no range join."""
    a = rows.withColumns({"_fact": F.lit(None).cast(facts.schema[value].dataType), "_side": F.lit(1)})
    columns = rows.columns
    b = facts.select(*(F.col(c) if c in (key, time, tie) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns), F.col(value).alias("_fact"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(time, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_fact", True).over(w)).where("_side = 1").drop("_fact", "_side")


def identity(rows: DataFrame, vendors: DataFrame, users: DataFrame, mac: str, ip: str) -> DataFrame:
    """Vendor by the first three bytes of the MAC, user by address. vendors: (oui, vendor); users: (ip, user)."""
    return rows.join(small(vendors), scalars.mac_oui(F.col(mac)) == F.col("oui"), "left").drop("oui").join(small(users.withColumnRenamed("ip", ip)), ip, "left")


def geo(rows: DataFrame, ranges: DataFrame, first: str = "dst", second: str = "src") -> DataFrame:
    """Country of the first address whose range is known. ranges: (low, high, country), disjoint. A range lies within /16 blocks: it is
    spread over those that it covers and joined on the block, then on the bounds."""
    blocks = ranges.select("*", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))).alias("_block"))
    out = rows
    for c in (first, second):
        n = scalars.ip_number(F.col(c))
        found = blocks.select(F.col("_block"), F.col("low"), F.col("high"), F.col("country").alias(f"_{c}"))
        out = out.join(small(found), (F.shiftright(n, 16) == F.col("_block")) & n.between(F.col("low"), F.col("high")), "left").drop("_block", "low", "high")
    return out.withColumn("country", F.coalesce(f"_{first}", f"_{second}")).drop(f"_{first}", f"_{second}")


def earlier_alerts(alerts: DataFrame, key: str, time: str = "us", seconds: int = 86_400) -> DataFrame:
    """Adds how many alerts of the same key the time before (rows of the same instant included, itself not) has."""
    w = Window.partitionBy(key).orderBy(time).rangeBetween(-seconds * 1_000_000, 0)
    return alerts.withColumn("earlier", F.count("*").over(w) - 1)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """NEW, GONE or BOTH per key, with the change of the value. One row per key on either side."""
    b, a = before.withColumnRenamed(value, "before_value"), after.withColumnRenamed(value, "after_value")
    state = F.when(F.col("before_value").isNull(), "NEW").when(F.col("after_value").isNull(), "GONE").otherwise("BOTH")
    return b.join(a, keys, "full").withColumns({"state": state, "delta": F.coalesce("after_value", F.lit(0)) - F.coalesce("before_value", F.lit(0))})
