"""Industrial operations, game connections, devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from .joins import small


def off_whitelist(ops: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds unlisted: the source is not on its protocol's list; false for protocols without a list. allowed: (protocol, src)."""
    lists = allowed.select("protocol").distinct().withColumn("_has", F.lit(True))
    known = allowed.select("protocol", "src").distinct().withColumn("_ok", F.lit(True))
    out = ops.join(small(lists), "protocol", "left").join(small(known), ["protocol", "src"], "left")
    return out.withColumn("unlisted", F.coalesce("_has", F.lit(False)) & F.col("_ok").isNull()).drop("_has", "_ok")


def prior_ops(rows: DataFrame, key: str, within_us: int, condition: Column | None = None) -> Column:
    """Operations of the source in the time before (below the limit), the row itself not counted."""
    w = Window.partitionBy(key).orderBy("us").rangeBetween(1 - within_us, 0)
    return (F.count("*") if condition is None else F.count_if(condition)).over(w) - 1


def op_anomalies(ops: DataFrame, allowed: DataFrame, rate: int = 100, rate_us: int = 100_000, writes: int = 50, writes_us: int = 1_000_000) -> DataFrame:
    """Adds anomaly: the first of UNAUTHORIZED, RATE, WRITE_FREQUENCY, PLC_CONTROL that holds, else null. ops: protocol, src, us, op_type."""
    o = off_whitelist(ops, allowed)
    o = o.withColumns({"_rate": prior_ops(o, "src", rate_us), "_before": prior_ops(o, "src", writes_us)})
    rules = ((F.col("unlisted"), "UNAUTHORIZED"), (F.col("_rate") >= rate, "RATE"), ((F.col("op_type") == "write") & (F.col("_before") >= writes), "WRITE_FREQUENCY"), (F.col("op_type") == "control", "PLC_CONTROL"))
    return o.withColumn("anomaly", F.coalesce(*(F.when(c, n) for c, n in rules))).drop("_rate", "_before", "unlisted")


def anomaly_breakdown(ops: DataFrame) -> DataFrame:
    """Counts by anomaly, protocol and operation type (grouping sets) with the share of anomalies."""
    sets = [[F.col(c)] for c in ("anomaly", "protocol", "op_type")]
    return ops.groupingSets(sets, "anomaly", "protocol", "op_type").agg(F.count("*").alias("ops"), (F.count("anomaly") * 100.0 / F.count("*")).alias("rate_pct"), F.grouping_id().alias("level"))


# Protocol, lowest and highest function code, severity, what it means.
ICS_FUNCTIONS = (
    ("MODBUS", 5, 6, "high", "single write"), ("MODBUS", 15, 16, "high", "multiple write"), ("MODBUS", 8, 8, "medium", "diagnostics"), ("MODBUS", 43, 43, "low", "device identification"),
    ("DNP3", 3, 5, "high", "operate"), ("DNP3", 13, 14, "critical", "restart"), ("DNP3", 18, 18, "critical", "stop application"), ("IEC104", 45, 51, "high", "control command"), ("IEC104", 100, 101, "low", "interrogation"), ("BACNET", 15, 16, "high", "write property"), ("BACNET", 20, 20, "critical", "reinitialize device"),
)


def ics_alerts(ops: DataFrame) -> DataFrame:
    """A row per operation whose function code is on the table; joined on the protocol, then on the range of codes."""
    table = ops.sparkSession.createDataFrame(list(ICS_FUNCTIONS), "protocol string, low int, high int, severity string, meaning string")
    return ops.join(F.broadcast(table), "protocol").where("function_code between low and high").drop("low", "high")


def service_summary(ops: DataFrame, statuses: DataFrame) -> DataFrame:
    """OPC UA: operations by service and status name, violations (bad status or security mode none). statuses: (status, status_name)."""
    named = ops.join(small(statuses), "status", "left").withColumn("status_name", F.coalesce("status_name", F.concat(F.lit("0x"), F.hex("status"))))
    bad = ~F.col("status_name").startswith("Good") | (F.col("security") == "None")
    return named.groupBy("service", "status_name").agg(F.count("*").alias("ops"), F.count_if(bad).alias("violations"))


def decode_quality(rows: DataFrame) -> DataFrame:
    """Adds warnings and risk (low, medium, high, critical by coverage 90, 70, 40 %). rows: coverage_pct, checksum_ok, truncated."""
    warnings = F.array_compact(F.array(F.when(F.col("coverage_pct") < 90, "partial decode"), F.when(~F.col("checksum_ok"), "bad checksum"), F.when(F.col("truncated"), "truncated")))
    c = F.col("coverage_pct")
    return rows.withColumns({"warnings": warnings, "risk": F.when(c >= 90, "low").when(c >= 70, "medium").when(c >= 40, "high").otherwise("critical")})


def jitter(samples: DataFrame, key: str, rtt: str, order: list[str], last: int = 128) -> DataFrame:
    """Adds jitter: population deviation of the last 128 samples, null below two."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    return samples.withColumn("jitter", F.when(F.count(rtt).over(w) >= 2, F.stddev_pop(rtt).over(w)))


def replication(samples: DataFrame, key: str) -> DataFrame:
    return samples.groupBy(key).agg(F.sum("updates").alias("updates"), F.sum("rpcs").alias("rpcs"), F.sum("bytes").alias("bytes"))


def desync_flags(samples: DataFrame, key: str) -> DataFrame:
    return samples.where("flag is not null").groupBy(key).agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def health_findings(connections: DataFrame) -> DataFrame:
    """A row per rule that a connection breaks. connections: rtt, loss_pct, tick, desync, jitter, rpcs_per_s, integrity, platform_ok, throttled."""
    c = F.col
    rules = (
        ("rtt critical", c("rtt") > 300), ("rtt high", (c("rtt") > 150) & (c("rtt") <= 300)), ("loss critical", c("loss_pct") > 5), ("loss", (c("loss_pct") > 1) & (c("loss_pct") <= 5)), ("low tick", c("tick") < 30), ("desync", c("desync")),
        ("jitter", (c("jitter") > 10) & (F.try_divide(c("jitter"), c("rtt")) > 0.25)), ("rpc flood", c("rpcs_per_s") > 100), ("integrity", ~c("integrity")), ("platform", ~c("platform_ok")), ("throttled", c("throttled")),
    )
    return connections.select("*", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in rules)))).alias("finding"))


def device_inventory(rows: DataFrame) -> DataFrame:
    """Per MAC: first and last seen (both roles), packets and bytes as sender, protocols as sender, private addresses (both roles), first host
    name. Group addresses (odd first byte) are left out. rows: us, seq, src_mac, dst_mac, src, dst, protocol, length, hostname."""
    role = F.explode(F.array(F.struct(F.col("src_mac").alias("mac"), F.col("src").alias("ip"), F.lit(True).alias("sent")), F.struct(F.col("dst_mac").alias("mac"), F.col("dst").alias("ip"), F.lit(False).alias("sent"))))
    r = rows.select("us", "seq", "protocol", "length", "hostname", role.alias("r")).select("us", "seq", "protocol", "length", "hostname", "r.*")
    single = F.conv(F.substring("mac", 2, 1), 16, 10).cast("int") % 2 == 0
    private = F.when(scalars.address_scope(F.col("ip")) == "private", F.col("ip"))
    return r.where(single).groupBy("mac").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_if("sent").alias("packets"), F.coalesce(F.sum(F.when(F.col("sent"), F.col("length"))), F.lit(0)).alias("bytes"),
        F.array_sort(F.collect_set(F.when(F.col("sent"), F.col("protocol")))).alias("protocols"), F.array_sort(F.collect_set(private)).alias("ips"), F.min_by("hostname", F.when(F.col("sent") & F.col("hostname").isNotNull(), F.col("seq"))).alias("hostname"),
    )


# What a service name or model text says about a device; first match wins.
DEVICE_RULES = (("(?i)iphone|ipad", "phone", "iOS"), ("(?i)macbook|imac", "computer", "macOS"), ("(?i)_ipp|printer", "printer", None), ("(?i)_googlecast|roku|appletv", "media", None), ("(?i)android", "phone", "Android"), ("(?i)msft", "computer", "Windows"))


def device_class(ttl: Column, text: Column) -> Column:
    """struct(kind, os): from names of services first, else from the band of the TTL (64 Unix, 128 Windows, above network gear)."""
    out = F.when(ttl <= 64, F.struct(F.lit("host").alias("kind"), F.lit("Unix").alias("os"))).when(ttl <= 128, F.struct(F.lit("computer").alias("kind"), F.lit("Windows").alias("os"))).when(ttl.isNotNull(), F.struct(F.lit("network").alias("kind"), F.lit(None).cast("string").alias("os")))
    for pattern, kind, os_ in reversed(DEVICE_RULES):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(os_).cast("string").alias("os"))).otherwise(out)
    return out


def merge_identity(rows: DataFrame, key: str, fields: list[str], weak: str = "weak", order: str = "seq") -> DataFrame:
    """Per key and field the first value that is known, strong ones before weak ones."""
    return rows.groupBy(key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(weak, order))).alias(f) for f in fields))
