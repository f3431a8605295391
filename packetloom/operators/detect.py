"""Detection rules in batch form. Recurrences that depend on what fired are in folds; everything else is a window or an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from . import blocks, filters, folds, matching, stats


def _bucket(seconds: float) -> Column:
    return F.floor(F.col("us") / int(seconds * 1_000_000))


def traffic_spikes(rows: DataFrame, seconds: float = 1, samples: int = 60, least: int = 10, sigmas: float = 3) -> DataFrame:
    """Buckets whose count exceeds mean + 3 population deviations of the last 60 buckets with traffic, itself included."""
    counts = rows.groupBy(_bucket(seconds).alias("bucket")).agg(F.count("*").alias("n"))
    out = stats.over_last(counts, "bucket", samples, {"samples": F.count("*"), "mean": F.avg("n"), "deviation": F.stddev_pop("n")})
    return out.where((F.col("samples") >= least) & (F.col("n") > F.col("mean") + sigmas * F.col("deviation")))


def error_bursts(rows: DataFrame, is_error: Column, seconds: float = 60, more_than: int = 5) -> DataFrame:
    return rows.where(is_error).groupBy(_bucket(seconds).alias("bucket")).agg(F.count("*").alias("errors")).where(F.col("errors") > more_than)


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each value, but for the very first of all: hosts or protocols that are new."""
    rest = [c for c in rows.columns if c != key]
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    start = firsts.agg(F.min(F.struct(*order)).alias("_start"))
    return firsts.join(F.broadcast(start)).where(F.struct(*order) != F.col("_start")).drop("_start")  # the start is one row


def beacons(rows: DataFrame, intervals: int = 4, variance: float = 0.05, least: float = 0.5) -> DataFrame:
    """Rows at which the last `intervals` gaps of (src, dst) have a population variance below the limit and a mean above the least (s)."""
    w = Window.partitionBy("src", "dst").orderBy("us", "seq")
    gap = (F.col("us") - F.lag("us").over(w)) / 1e6
    last = w.rowsBetween(1 - intervals, 0)
    out = rows.withColumn("_gap", gap).withColumns({"gaps": F.count("_gap").over(last), "mean_gap": F.avg("_gap").over(last), "gap_variance": F.var_pop("_gap").over(last)})
    return out.where((F.col("gaps") == intervals) & (F.col("gap_variance") < variance) & (F.col("mean_gap") > least)).drop("_gap")


def capture_beacons(rows: DataFrame, contacts: int = 8, spread: float = 0.1) -> DataFrame:
    """Destinations that a source contacts at a regular interval over the whole capture: deviation / mean of the gaps below the limit."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("src", "dst").orderBy("us", "seq"))) / 1e6
    out = rows.withColumn("_gap", gap).groupBy("src", "dst").agg(F.count("*").alias("contacts"), F.avg("_gap").alias("interval"), F.try_divide(F.stddev_pop("_gap"), F.avg("_gap")).alias("spread"))
    return out.where((F.col("contacts") >= contacts) & (F.col("spread") < spread))


def outbound_over(rows: DataFrame, limit: int = 100_000_000) -> DataFrame:
    """The row at which a source's bytes to public addresses first exceed the limit."""
    w = Window.partitionBy("src").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.where(scalars.address_scope(F.col("dst")) == "public").withColumn("sent", F.sum("length").over(w))
    return out.where((F.col("sent") > limit) & (F.col("sent") - F.col("length") <= limit))


def fan_out_windows(rows: DataFrame, least: int = 5, seconds: float = 10) -> DataFrame:
    """Fast form of lateral movement: fixed buckets with enough distinct destinations."""
    return rows.groupBy("src", _bucket(seconds).alias("bucket")).agg(F.countDistinct("dst").alias("destinations")).where(F.col("destinations") >= least)


# One packet decides: name and predicate.
PACKET_RULES = {
    "privileged_source": lambda: filters.two_valued((F.col("sport") < 1024) & F.col("dport").isin(22, 3389, 445)),
    "dns_tunnel": lambda: (F.col("protocol") == "DNS") & (F.length("summary") > 60),
    "dga": lambda: scalars.char_entropy(F.element_at(F.split("summary", " "), -1)) > 4.2,
    "protocol_mismatch": lambda: ((F.col("protocol") == "TLS") & (F.col("dport") == 80)) | ((F.col("protocol") == "HTTP") & (F.col("dport") == 443)),
    "expired_certificate": lambda: F.lower("summary").contains("certificate expired"),
    "weak_cipher": lambda: F.upper("summary").rlike("RC4|3DES|NULL|EXPORT"),
    "no_pqc": lambda: (F.col("dport") == 443) & ~F.lower("summary").rlike("mlkem|kyber|pqc"),
    "cleartext_credentials": lambda: (F.col("protocol") == "HTTP") & F.lower("summary").rlike("passw(or)?d=|pwd=|authorization: basic"),
}


def odd_domain(domain: Column) -> Column:
    """First label longer than 25 characters or with more than 8 digits."""
    label = F.substring_index(domain, ".", 1)
    return filters.two_valued((F.length(label) > 25) | (F.length(F.regexp_replace(label, "[^0-9]", "")) > 8))


def sliding_threshold(rows: DataFrame, keys: list[str], count: int, seconds: float) -> DataFrame:
    """Rows with `count` matches of the key within the window that ends with them; nothing is reset."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-int(seconds * 1_000_000), 0)
    return rows.withColumn("matches", F.count("*").over(w)).where(F.col("matches") >= count)


def timed_threshold(rows: DataFrame, keys: list[str], count: int, seconds: float, start: str, end: str, minute: Column) -> DataFrame:
    """Like sliding_threshold, with half the count inside the hours."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-int(seconds * 1_000_000), 0)
    need = F.when(filters.time_in_range(minute, start, end), F.lit(count // 2)).otherwise(F.lit(count))
    return rows.withColumn("matches", F.count("*").over(w)).where(F.col("matches") >= need)


def correlated(rows: DataFrame, words: list[str], key: str = "src", text: str = "summary") -> DataFrame:
    """Keys that have shown all words, in any order, with the time at which the last of them first came."""
    firsts = [F.min(F.when(F.col(text).contains(w), F.col("us"))) for w in words]
    g = rows.groupBy(key).agg(*(f.alias(f"_w{i}") for i, f in enumerate(firsts)))
    done = [F.col(f"_w{i}") for i in range(len(words))]
    return g.where(filters.all_of(*(d.isNotNull() for d in done))).select(key, (F.greatest(*done) if len(done) > 1 else done[0]).alias("us"))


def correlations(rows: DataFrame, words: list[str], key: str = "src", text: str = "summary", cooldown: float = 10) -> DataFrame:
    """Rows at which a key has shown all words, in any order, since it last fired; then it starts anew. Within the cooldown nothing fires
    and what was seen stays. Only rows that hold one of the words are walked."""
    gap, whole = int(cooldown * 1_000_000), (1 << len(words)) - 1
    shown, (mark,) = F.lit(0), blocks.unused(rows, "words")
    for i, word in enumerate(words):
        shown = shown + F.when(F.col(text).contains(word), 1 << i).otherwise(0)

    def advance(state, t, mask):
        seen, last = state or (0, None)
        seen |= mask
        fires = seen == whole and (last is None or t - last >= gap)
        return ((0, t) if fires else (seen, last)), fires

    return folds.fold(rows.withColumn(mark, shown).where(F.col(mark) > 0), [key], ["us", "seq"], ["us", mark], advance).drop(mark)


def absences(rows: DataFrame, matches: Column, key: str, seconds: float) -> DataFrame:
    """Matches of a key after which none follows for longer than the window (up to the key's last row of any kind)."""
    w = Window.partitionBy(key)
    marked = rows.withColumn("_end", F.max("us").over(w)).where(matches)
    nxt = F.coalesce(F.lead("us").over(w.orderBy("us", "seq")), F.col("_end"))
    return marked.withColumn("silent_us", nxt - F.col("us")).where(F.col("silent_us") > int(seconds * 1_000_000)).drop("_end")


def distinct_over(rows: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Keys with at least so many distinct values: distributed scans, port scans, sweeps."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("values")).where(F.col("values") >= least)


def signature_hits(rows: DataFrame, signatures: DataFrame, text: str, key: str) -> DataFrame:
    """(row, name): rows whose text holds a signature's words, without regard to case. signatures: (name, words)."""
    return matching.holding(rows, key, F.lower(text), signatures.select("name", F.lower("words").alias("words")), F.col("words"))


def attack_chains(rows: DataFrame, stages: list[tuple[str, Column]], actor: str, target: str, within_s: float | None = None) -> DataFrame:
    """Per actor and target: share of stages seen, whether at least 90 %, and whether their first times come in order (within a span)."""
    g = rows.groupBy(actor, target).agg(*(F.min(F.when(c, F.col("us"))).alias(f"_{n}") for n, c in stages))
    times = [F.col(f"_{n}") for n, _ in stages]
    seen = sum((t.isNotNull().cast("int") for t in times), F.lit(0))
    ordered = filters.all_of(*(a <= b for a, b in zip(times, times[1:])))
    if within_s is not None:
        ordered = ordered & (times[-1] - times[0] <= int(within_s * 1_000_000))
    out = g.withColumns({"completion": seen / len(stages), "in_order": F.coalesce(ordered, F.lit(False))})
    return out.where(seen > 0).withColumn("confirmed", F.col("completion") >= 0.9).select(actor, target, "completion", "confirmed", "in_order")


def escalations(alerts: DataFrame, as_of_us: int, waits: tuple[int, ...] = (15, 30, 60)) -> DataFrame:
    """Steps due for alerts that nobody acknowledged: step i after the sum of the first i waits (minutes), with the ISO week on call."""
    due = [sum(waits[: i + 1]) for i in range(len(waits))]
    age = (F.lit(as_of_us) - F.col("created_us")) / 60_000_000
    steps = F.filter(F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(m).alias("after_min")) for i, m in enumerate(due))), lambda s: s["after_min"] <= age)
    return alerts.where("status = 'open'").select("*", F.explode(steps).alias("_s")).select("*", "_s.*").drop("_s")
