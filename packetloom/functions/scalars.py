"""Column functions: entropy, checksums, addresses, durations, sizes. All are built from Spark's own functions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entropy(symbols: Column) -> Column:
    """Bits per symbol of an array, 0 if empty: log2 n minus the mean of log2 of the runs of the sorted array."""
    n = F.size(symbols)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total"))
    weight = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(s: Column, x: Column) -> Column:
        same = s["last"] == x
        return F.struct(x.alias("last"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), F.when(same, s["total"]).otherwise(s["total"] + weight(s["run"])).alias("total"))

    runs = F.aggregate(F.sort_array(symbols), start, step, lambda s: s["total"] + weight(s["run"]))
    return F.when(n > 0, F.abs(F.log2(n) - runs / n)).otherwise(0.0)


def byte_entropy(data: Column) -> Column:
    """Shannon entropy of a binary value in bits per byte, 0 if empty. Each step takes all copies of the first byte out of the rest, one character a
    byte; the copies are counted a step later, so that the replacement is evaluated once."""
    n = F.octet_length(data)
    text = F.decode(data, "ISO-8859-1")
    start = F.struct(text.alias("rest"), n.alias("size"), F.lit(0.0).alias("total"))

    def counted(s: Column) -> Column:
        run = s["size"] - F.length(s["rest"])
        return s["total"] + run * F.log2(F.greatest(run, F.lit(1)))

    def step(s: Column, _: Column) -> Column:
        return F.struct(F.replace(s["rest"], F.substring(s["rest"], 1, 1), F.lit("")).alias("rest"), F.length(s["rest"]).alias("size"), counted(s).alias("total"))

    runs = F.aggregate(F.array_repeat(F.lit(0), F.least(n, F.lit(256))), start, step, counted)
    return F.when(n > 0, F.abs(F.log2(n) - runs / n)).otherwise(0.0)


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text."""
    return F.when(F.length(text) > 0, _entropy(F.split(text, ""))).otherwise(0.0)


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum of a text of digits; false for anything else."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    total = F.aggregate(values, F.lit(0), lambda a, b: a + b)
    return F.when(digits.rlike("^[0-9]+$"), total % 10 == 0).otherwise(False)


def national_id_valid(text: Column) -> Column:
    """Checksum of an 11-digit national number: no leading 0; digits 10 and 11 follow from the others."""
    d = [F.substring(text, i, 1).cast("int") for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    tenth, last = F.pmod(odd * 7 - even, F.lit(10)), (odd + even + d[9]) % 10
    return F.when(text.rlike("^[1-9][0-9]{10}$"), (tenth == d[9]) & (last == d[10])).otherwise(False)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), the value being computed once a row however often it is named in it: also where a filter or a projection below takes the
    place of a column."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""

    def number(parts: Column) -> Column:
        return parts[0].cast("long") * 16777216 + parts[1].cast("long") * 65536 + parts[2].cast("long") * 256 + parts[3].cast("long")

    return once(ip, lambda a: F.when(a.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), once(F.split(a, r"\."), number)))


def _within(number: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    return F.coalesce(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))


def in_network(ip: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network such as 10.0.0.0/8; false for null and IPv6."""
    return once(ip_number(ip), lambda n: _within(n, network))


# Ranges that are not public, with their scope; the whole of 172.16/12 is private.
SCOPES = (("loopback", "127.0.0.0/8"), ("link-local", "169.254.0.0/16"), ("private", "10.0.0.0/8"), ("private", "172.16.0.0/12"), ("private", "192.168.0.0/16"))


def address_scope(ip: Column) -> Column:
    """loopback, link-local, private or public; null stays null. IPv6: ::1, fe80::/10, fc00::/7."""

    def six(a: Column) -> Column:
        return F.when(a == "::1", "loopback").when(F.lower(a).rlike("^fe[89ab]"), "link-local").when(F.lower(a).rlike("^f[cd]"), "private").otherwise("public")

    def four(number: Column) -> Column:
        return reduce(lambda out, s: out.when(_within(number, s[1]), s[0]), SCOPES, F.when(F.lit(False), "")).otherwise("public")

    return once(ip, lambda a: F.when(a.contains(":"), six(a)).when(a.isNotNull(), once(ip_number(a), four)))


def ip_sort_key(ip: Column) -> Column:
    """Text whose order is that of addresses as numbers, IPv4 before IPv6 (compressed zeros expanded)."""
    groups = F.split(ip, ":")
    filled = F.flatten(F.transform(groups, lambda g, i: F.when((g == "") & (i > 0) & (i < F.size(groups) - 1), F.array_repeat(F.lit("0"), 9 - F.size(groups))).when(g == "", F.array(F.lit("0"))).otherwise(F.array(g))))
    six = F.concat(F.lit("6"), F.array_join(F.transform(filled, lambda g: F.lpad(F.lower(g), 4, "0")), ""))
    return F.when(ip.contains(":"), six).otherwise(F.concat(F.lit("4"), F.lpad(F.hex(ip_number(ip)), 8, "0")))


def duration_seconds(text: Column) -> Column:
    """30s, 5m or 1h in seconds; anything else is 30."""
    number, unit = F.regexp_extract(text, "^([0-9]+)([smh])$", 1), F.regexp_extract(text, "^([0-9]+)([smh])$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600)
    return F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999999")).cast("long") * factor, F.lit(30)).cast("long")


def human_bytes(n: Column, step: int = 1024) -> Column:
    """500 B, 145.0 KB, 2.2 MB and so on."""
    out = F.when(n < step, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        text = F.format_string(f"%.1f {unit}", F.bround(n / float(step**power), 1))  # ties go to the even digit
        out = out.when(n < step ** (power + 1), text) if unit != "GB" else out.otherwise(text)
    return out


def has_token(text: Column, token: str) -> Column:
    """Whether a text holds a word, in any case, bounded by anything but letters and digits."""
    return F.coalesce(text.rlike(f"(?i)(^|[^a-z0-9]){token}([^a-z0-9]|$)"), F.lit(False))


def host_of(url: Column) -> Column:
    """Host of a URL or of a Host header: lower case, no port, no path."""
    rest = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), ":[0-9]+$", "")


def mac_text(mac: Column) -> Column:
    """Six bytes as aa:bb:cc:dd:ee:ff."""
    return F.lower(F.array_join(F.regexp_extract_all(F.hex(mac), F.lit("(..)"), F.lit(1)), ":"))


def mac_oui(mac: Column) -> Column:
    """The vendor part of a MAC address in text form: the first three bytes, upper case."""
    return F.upper(F.substring(F.regexp_replace(mac, "-", ":"), 1, 8))


def sampled(rows: DataFrame, every: int, order: str = "seq", partition: str | None = None) -> DataFrame:
    """Every n-th row with the ratio that it stands for. Give a partition column for large inputs: each partition counts by itself."""
    by = f"partition by {partition} " if partition else ""
    return rows.selectExpr("*", f"row_number() over ({by}order by {order}) as _n").where(f"_n % {every} = 1 % {every}").drop("_n").withColumn("sampling_ratio", F.lit(every))
