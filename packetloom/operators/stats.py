"""Traffic statistics: totals, tops, rates, histograms, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks, filters, selection


def totals(rows: DataFrame, by: list[str] | None = None, length: str = "length") -> DataFrame:
    """packets and bytes, in total or by columns."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("packets"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"))


# Upper ends of the length bins.
LENGTH_BINS = ((79, "0-79"), (639, "80-639"), (1279, "640-1279"), (1500, "1280-1500"))


def length_histogram(rows: DataFrame, length: str = "length") -> DataFrame:
    bin_ = F.lit(">1500")
    for top, name in reversed(LENGTH_BINS):
        bin_ = F.when(F.col(length) <= top, name).otherwise(bin_)
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("packets"))


def protocol_hierarchy(rows: DataFrame) -> DataFrame:
    """Counts at each level: all frames, network, transport, application (rollup)."""
    l3 = F.when(F.col("src").contains(":") | F.col("dst").contains(":"), "IPv6").otherwise("IPv4")
    return rows.select(l3.alias("l3"), filters.transport().alias("l4"), F.col("protocol").alias("app"), "length").rollup("l3", "l4", "app").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.grouping_id().alias("level"))


def top(rows: DataFrame, key: str, n: int = 10, length: str = "length") -> DataFrame:
    """The n keys with most bytes; ties by key. Partial sums before the shuffle, n rows a task after it."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("packets"), F.sum(length).alias("bytes")).orderBy(F.desc("bytes"), key).limit(n)


def over_last(rows: DataFrame, order: str, samples: int, values: dict[str, Column], span: int = 100_000) -> DataFrame:
    """Aggregates over each row and those before it, `samples` in all, in the order of a column of different whole numbers. No task orders
    more than `span` rows: each range of numbers is counted, rows get their place by the sums of the ranges before (a row for each range,
    the only thing that one task orders whole), and blocks of places are windows that begin with the last rows of the block before."""
    span = max(span, samples)
    part = F.floor(F.col(order) / span)
    ranges = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = ranges.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    placed = rows.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    placed = placed.join(before, "_part").withColumn("_place", F.col("_place") + F.col("_before"))
    block, ahead = F.floor(F.col("_place") / span), F.col("_place") % span >= span - samples + 1
    dealt = placed.withColumn("_block", F.explode(F.when(ahead, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy("_block").orderBy("_place").rowsBetween(1 - samples, 0)
    return dealt.withColumns({name: value.over(w) for name, value in values.items()}).where(F.col("_block") == block).select(*rows.columns, *values)


def rate_with_mean(rows: DataFrame, seconds: int = 1, samples: int = 60, time: str = "us", length: str = "length") -> DataFrame:
    """Bytes per bucket and their mean over the last samples that had traffic. """
    buckets = rows.groupBy(F.floor(F.col(time) / (seconds * 1_000_000)).alias("bucket")).agg(F.sum(length).alias("bytes"))
    return over_last(buckets, "bucket", samples, {"mean_bytes": F.avg("bytes")})


def tiles(rows: DataFrame, seconds: int) -> DataFrame:
    """Per bucket: bytes, packets, share of errors, active sources."""
    bucket = F.floor(F.col("us") / (seconds * 1_000_000))
    return rows.groupBy(bucket.alias("bucket")).agg(F.sum("length").alias("bytes"), F.count("*").alias("packets"), (F.count_if(F.col("kind") == "error") / F.count("*")).alias("error_rate"), F.countDistinct("src").alias("hosts"))


def busiest(rows: DataFrame, seconds: int) -> DataFrame:
    """The bucket with most bytes (the earliest of equals) and the hour of day with most bytes."""
    buckets = rows.groupBy(F.floor(F.col("us") / (seconds * 1_000_000)).alias("bucket")).agg(F.sum("length").alias("bytes"))
    hours = rows.groupBy("hour").agg(F.sum("length").alias("bytes"))
    best = buckets.agg(F.max_by("bucket", F.struct("bytes", -F.col("bucket"))).alias("bucket"), F.max("bytes").alias("bucket_bytes"))
    return best.crossJoin(hours.agg(F.max_by("hour", F.struct("bytes", -F.col("hour"))).alias("hour"), F.max("bytes").alias("hour_bytes")))  # one row each


def trend(rows: DataFrame, seconds: int, ahead: int) -> DataFrame:
    """Least squares over the bytes of each bucket, projected ahead buckets on."""
    buckets = rows.groupBy(F.floor(F.col("us") / (seconds * 1_000_000)).cast("double").alias("x")).agg(F.sum("length").cast("double").alias("y"))
    fit = buckets.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"), F.max("x").alias("last"), F.avg("y").alias("mean"))
    share = F.col("slope") / F.col("mean")
    return fit.select("slope", (F.col("base") + F.col("slope") * (F.col("last") + ahead)).alias("projected"), F.when(share > 0.01, "rising").when(share < -0.01, "falling").otherwise("steady").alias("direction"))


def capture_info(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Packets, bytes, first and last time in file order, duration in microseconds."""
    return rows.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min_by("us", order).alias("first_us"), F.max_by("us", order).alias("last_us"), (F.max_by("us", order) - F.min_by("us", order)).alias("duration_us"))


def token_entropy(rows: DataFrame, column: str) -> DataFrame:
    """Shannon entropy of the distribution of a column's values; sums need no total order of rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(share * F.log2(share)), F.lit(0.0)).alias("entropy"))  # the total is one row


def quartile_outliers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows outside q1 - 1.5 iqr .. q3 + 1.5 iqr of their key, quartiles at places n/4 and 3n/4 of the sorted values; keys with fewer
    than 4 values have none."""
    fences = selection.places(rows, [key], value, {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(n * 3 / 4)}).where("n >= 4")
    iqr = F.col("q3") - F.col("q1")
    return rows.join(fences.drop("n"), key).where((F.col(value) < F.col("q1") - 1.5 * iqr) | (F.col(value) > F.col("q3") + 1.5 * iqr))


def summary_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, max, avg, median (place n/2), p95 (place min(ceil(0.95 n), n - 1)) of each group."""
    ends = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    inner = selection.places(rows, by, value, {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.ceil(n * 0.95), n - 1)})
    return blocks.join_on(ends, inner, by, ["median", "p95"])


def nearest_rank(rows: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles at place round((n - 1) p) of the sorted values."""
    return selection.places(rows, by, value, {f"p{round(p * 100)}": lambda n, p=p: F.round((n - 1) * p) for p in shares}).drop("n")


def site_errors(rows: DataFrame, site: str, code: str) -> DataFrame:
    """Counts of 4xx and 5xx answers per site and code, with the reason."""
    reasons = rows.sparkSession.createDataFrame([(400, "Bad Request"), (401, "Unauthorized"), (403, "Forbidden"), (404, "Not Found"), (408, "Request Timeout"), (429, "Too Many Requests"), (500, "Internal Server Error"), (502, "Bad Gateway"), (503, "Service Unavailable"), (504, "Gateway Timeout")], f"{code} int, reason string")
    return rows.where(F.col(code).between(400, 599)).groupBy(site, code).agg(F.count("*").alias("n")).join(F.broadcast(reasons), code, "left")  # a table of fixed size


def exposure_score(rows: DataFrame, site: str) -> DataFrame:
    """0 to 100 per site: cleartext 30, credentials 40, errors 20 (by share), telemetry 10."""
    text = F.lower("summary")
    return rows.groupBy(site).agg(
        F.least(
            F.lit(100.0),
            30.0 * F.max((F.col("protocol") == "HTTP").cast("int")) + 40.0 * F.max(text.contains("password=").cast("int")) + 20.0 * F.avg((F.col("kind") == "error").cast("double")) + 10.0 * F.max(filters.is_noise().cast("int")),
        ).alias("score")
    )


def services(rows: DataFrame, host: str, owners: DataFrame) -> DataFrame:
    """Requests by the owner of the host's domain. owners: (suffix, owner); the longest suffix of two labels or more wins."""
    parts = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))
    hosts = rows.groupBy(host).agg(F.count("*").alias("n"))
    matched = hosts.select(host, "n", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(owners, "suffix", "left").groupBy(host, "n").agg(F.max_by("owner", F.when(F.col("owner").isNotNull(), F.length("suffix"))).alias("owner"))
    return matched.groupBy(F.coalesce("owner", F.lit("other")).alias("owner")).agg(F.sum("n").alias("requests"), F.count("*").alias("hosts"))


# What names a tracker, a firewall for web applications, or a banner of an outdated server.
HOST_RULES = (("tracker", "(?i)(^|[.])(track|ads?|metrics|analytics)[.-]"), ("waf", "(?i)cloudflare|akamai|incapsula"), ("outdated", "(?i)apache/2[.][02]|openssl/1[.]0"))


def classify_hosts(rows: DataFrame, host: str, text: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(n)) for n, p in HOST_RULES)))
    return rows.select(host, F.explode(found).alias("mark")).groupBy(host).agg(F.array_sort(F.collect_set("mark")).alias("marks"))


def voip_calls(rows: DataFrame, summary: str = "summary") -> DataFrame:
    """RTP streams by SSRC from summaries: packets, mean jitter, and the mean opinion score that the jitter allows."""
    ssrc = F.nullif(F.regexp_extract(summary, "SSRC=0x([0-9A-Fa-f]+)", 1), F.lit(""))
    jitter = F.nullif(F.regexp_extract(summary, r"jitter=([0-9.]+)", 1), F.lit("")).cast("double")
    return rows.select(ssrc.alias("ssrc"), jitter.alias("jitter")).where("ssrc is not null").groupBy("ssrc").agg(F.count("*").alias("packets"), F.avg("jitter").alias("jitter_ms")).withColumn("mos", F.greatest(F.lit(1.0), F.lit(4.4) - F.coalesce("jitter_ms", F.lit(0.0)) / 50))


def encrypted_share(rows: DataFrame) -> DataFrame:
    """round(100 tls / (tls + http)); null without either."""
    tls, http = F.count_if(F.col("protocol") == "TLS"), F.count_if(F.col("protocol") == "HTTP")
    return rows.agg(tls.alias("tls"), http.alias("http")).withColumn("encrypted_pct", F.round(F.try_divide(F.col("tls") * 100, F.col("tls") + F.col("http"))).cast("long"))
