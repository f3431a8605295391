"""Masking, sensitive data, retention, anonymisation, audit chain."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from . import folds, matching

# How secrets begin.
SECRET_PREFIXES = "^(sk-|pk_|ghp_|gho_|xox[abp]-|AKIA|AIza|eyJ)"


def mask_text(text: Column) -> Column:
    """Words of a text with e-mail addresses, card numbers, national ids, secrets and phone numbers replaced; white space collapses.
    One pattern tells texts and words that cannot change, so that most are never looked at word by word. Null gives null."""

    may_change = f"[0-9@]|{SECRET_PREFIXES}"

    def mask(word: Column) -> Column:
        digits = F.regexp_replace(word, "[^0-9]", "")
        n = F.length(digits)
        numeric = word.rlike("^[0-9+() .-]+$")
        card = numeric & ((n == 16) | (n.between(13, 19) & scalars.luhn_valid(digits)))
        return (
            F.when(~word.rlike(may_change), word)
            .when(word.rlike("^[^@ ]+@[^@ ]+[.][A-Za-z]{2,}[.,;]?$"), "[EMAIL]")
            .when(card, "[CARD]")
            .when(numeric & scalars.national_id_valid(digits), "[ID]")
            .when(word.rlike(SECRET_PREFIXES), "[SECRET]")
            .when(numeric & n.between(10, 13), "[PHONE]")
            .otherwise(word)
        )

    words = F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), mask), " ")
    collapsed = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(text.rlike(may_change.replace("^", r"(?:^|\s)")), words).otherwise(collapsed)


# Kind of finding, severity rank (lower first), pattern.
SENSITIVE = (
    ("private_key", 0, "(-----BEGIN [A-Z ]*PRIVATE KEY-----)"), ("aws_key", 0, r"\b(AKIA[0-9A-Z]{16})\b"), ("vendor_key", 0, r"\b((?:ghp|gho)_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b"), ("jwt", 0, r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})"),
    ("credential", 1, r"(?i)\b((?:password|passwd|token|secret)\s*[=:]\s*\S+)"), ("card", 2, r"\b((?:4[0-9]{15}|5[1-5][0-9]{14}|3[47][0-9]{13}))\b"), ("iban", 2, r"\b([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})\b"), ("email", 3, r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"),
)


def sensitive_data(rows: DataFrame, text: str) -> DataFrame:
    """(row columns, kind, rank, value): distinct findings of each row; card numbers need a right checksum."""
    def named(kind: str, rank: int):
        return lambda value: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), value.alias("value"))

    found = F.flatten(F.array(*(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), named(kind, rank)) for kind, rank, pattern in SENSITIVE)))
    out = rows.select("*", F.explode(found).alias("_f")).select(*rows.columns, "_f.*")
    return out.where((F.col("kind") != "card") | scalars.luhn_valid(F.col("value")))


def leak_rollup(findings: DataFrame, endpoint: str) -> DataFrame:
    """One row per value: uses and endpoints, secrets first."""
    return findings.groupBy("kind", "rank", "value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(endpoint)).alias("endpoints")).orderBy("rank", F.desc("n"), "value")


def with_retention(files: DataFrame, policy: DataFrame, as_of_us: int) -> DataFrame:
    """Adds purge: older in whole days than its type allows. policy: (file_type, max_days); types without one stay."""
    days = F.floor((F.lit(as_of_us) - F.col("us")) / 86_400_000_000)
    return files.join(matching.small(policy), "file_type", "left").withColumn("purge", F.coalesce(days > F.col("max_days"), F.lit(False))).drop("max_days")


def storage_tier(us: Column, as_of_us: int) -> Column:
    return F.when(F.lit(as_of_us) - us < 7 * 86_400_000_000, "hot").otherwise("cold")


def erase_ip(rows: DataFrame, ip: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the address at either end, one row with the number removed)."""
    hit = F.coalesce(F.col("src") == ip, F.lit(False)) | F.coalesce(F.col("dst") == ip, F.lit(False))
    return rows.where(~hit), rows.where(hit).agg(F.count("*").alias("removed"))


def anonymise_ip(ip: Column) -> Column:
    """IPv4 to its /24, IPv6 to its /48."""
    six = F.concat(F.array_join(F.slice(F.split(ip, ":"), 1, 3), ":"), F.lit("::"))
    short = F.concat(F.substring_index(ip, "::", 1), F.lit("::"))
    return F.when(ip.contains("::") & (F.size(F.split(F.substring_index(ip, "::", 1), ":")) <= 3), short).when(ip.contains(":"), six).otherwise(F.regexp_replace(ip, r"\.[0-9]+$", ".0"))


def pseudonyms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Addresses replaced by the same made-up one everywhere (10.x.y.z in order of the addresses); loopback stays.

    The dictionary holds each address once; its numbers come from counts per range of the order, not from one sorted task."""
    spark = rows.sparkSession
    ips = None
    for c in columns:
        part = rows.select(F.col(c).alias("ip"))
        ips = part if ips is None else ips.union(part)
    ips = ips.where("ip is not null and not ip like '127.%' and ip <> '::1'").distinct().withColumn("_b", F.substring(F.md5("ip"), 1, 3))
    starts = ips.groupBy("_b").agg(F.count("*").alias("_n")).selectExpr("_b", "sum(_n) over (order by _b) - _n as _start")  # at most 4096 rows
    n = F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("ip"))
    named = ips.join(F.broadcast(starts), "_b").select("ip", F.format_string("10.%d.%d.%d", F.shiftright(n, 16) % 256, F.shiftright(n, 8) % 256, n % 256).alias("alias"))
    out = rows
    for c in columns:
        out = out.join(named.select(F.col("ip").alias(c), F.col("alias").alias("_alias")), c, "left").withColumn(c, F.coalesce("_alias", c)).drop("_alias")
    return out.select(*rows.columns)


AUDIT_FIELDS = ("id", "prev_hash", "user_id", "action", "resource", "ip_address", "timestamp_epoch")


def entry_hash() -> Column:
    return F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in AUDIT_FIELDS)), 256)


def chain_entries(rows: DataFrame, by: str, genesis: str = "0" * 64) -> DataFrame:
    """Adds prev_hash and entry_hash to rows with the other audit fields: each row holds the hash of the one before it in its chain, by id."""
    rest = F.concat_ws(":", *(F.col(c).cast("string") for c in AUDIT_FIELDS[2:]))

    def advance(last, head, tail):
        prev = genesis if last is None else last
        own = hashlib.sha256(":".join(filter(None, (head, prev, tail))).encode()).hexdigest()
        return own, [prev, own]

    texts = rows.withColumns({"_head": F.col("id").cast("string"), "_tail": rest})
    hashed = folds.fold(texts, [by], ["id"], ["_head", "_tail"], advance, "_hashes array<string>")
    return hashed.withColumns({"prev_hash": F.col("_hashes")[0], "entry_hash": F.col("_hashes")[1]}).drop("_head", "_tail", "_hashes")


def verify_chain(entries: DataFrame, genesis: str = "0" * 64, by: str | None = None) -> DataFrame:
    """Entries whose previous hash or own hash is wrong; the first bad id is their minimum. by: chains of their own."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("id")
    expected = F.coalesce(F.lag("entry_hash").over(w), F.lit(genesis))
    return entries.withColumn("_expected", expected).where((F.col("prev_hash") != F.col("_expected")) | (F.col("entry_hash") != entry_hash())).drop("_expected")


def mask_secret(value: Column, keep: int = 4) -> Column:
    """Long values show both ends, shorter ones the last four characters, those of up to four nothing."""
    n = F.length(value)
    stars = lambda k: F.repeat(F.lit("*"), k)
    return F.when(n <= keep, stars(n)).when(n <= 3 * keep, F.concat(stars(n - keep), F.right(value, F.lit(keep)))).otherwise(F.concat(F.left(value, F.lit(keep)), stars(n - 2 * keep), F.right(value, F.lit(keep))))
