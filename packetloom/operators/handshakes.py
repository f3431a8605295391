"""TLS fingerprints and post-quantum adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _plain(numbers: Column) -> Column:
    """Without GREASE: values whose two bytes are equal and end in A."""
    return F.filter(numbers, lambda x: ~((F.pmod(x, F.lit(16)) == 10) & (F.shiftright(x, 8) == F.pmod(x, F.lit(256)))))


def _dashed(numbers: Column) -> Column:
    return F.array_join(F.transform(_plain(numbers), lambda x: x.cast("string")), "-")


def ja3_text(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), _dashed(ciphers), _dashed(extensions), _dashed(groups), _dashed(formats))


def ja3s_text(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), cipher.cast("string"), _dashed(extensions))


def _hexed(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))


def _short_hash(text: Column) -> Column:
    return F.when(text == "", "0" * 12).otherwise(F.substring(F.sha2(text, 256), 1, 12))


def ja4(version: Column, ciphers: Column, extensions: Column, signatures: Column, versions: Column, alpn: Column, sni: Column, transport: str = "t") -> Column:
    """Prefix (transport, version, d or i, counts, ALPN) and two short hashes: sorted ciphers; sorted extensions without SNI and ALPN, with
    the signature algorithms in their order."""
    c, e = _plain(ciphers), _plain(extensions)
    best = F.coalesce(F.array_max(_plain(versions)), version)
    tls = F.when(best == 0x0304, "13").when(best == 0x0303, "12").when(best == 0x0302, "11").when(best == 0x0301, "10").otherwise("00")
    count = lambda a: F.lpad(F.least(F.size(a), F.lit(99)).cast("string"), 2, "0")
    first = F.when(F.size(alpn) > 0, alpn[0])
    tag = F.when(first.isNull() | (first == ""), "00").otherwise(F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1)))
    prefix = F.concat(F.lit(transport), tls, F.when(sni.isNull(), "i").otherwise("d"), count(c), count(e), tag)
    rest = F.array_join(F.array_sort(_hexed(F.filter(e, lambda x: ~x.isin(0, 16)))), ",")
    signed = F.when(F.size(signatures) > 0, F.concat(rest, F.lit("_"), F.array_join(_hexed(_plain(signatures)), ","))).otherwise(rest)
    return F.concat_ws("_", prefix, _short_hash(F.array_join(F.array_sort(_hexed(c)), ",")), _short_hash(signed))


def fingerprint_census(rows: DataFrame, fingerprint: str, host: str) -> DataFrame:
    """Uses and distinct hosts of each fingerprint, rare if only one host has it."""
    return rows.groupBy(fingerprint).agg(F.count("*").alias("uses"), F.countDistinct(host).alias("hosts")).withColumn("rare", F.col("hosts") == 1)


def adoption(observations: DataFrame, connection: list[str]) -> DataFrame:
    """Per connection: packets, algorithms, first and last seen, whether any was hybrid."""
    return observations.groupBy(*connection).agg(F.count("*").alias("packets"), F.array_sort(F.collect_set("algorithm")).alias("algorithms"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.bool_or("hybrid").alias("hybrid"))


def hybrid_ratio(connections: DataFrame) -> DataFrame:
    return connections.agg(F.coalesce(F.avg(F.col("hybrid").cast("double")), F.lit(0.0)).alias("hybrid_ratio"))


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


# Security level of key encapsulation mechanisms, and known weaknesses.
LEVELS = (("ML-KEM-512", 1), ("ML-KEM-768", 3), ("ML-KEM-1024", 5), ("X25519MLKEM768", 3), ("HQC-128", 1), ("SIKEp434", 0))
BROKEN = ("SIKEp434",)


def level_distribution(rows: DataFrame, algorithm: str) -> DataFrame:
    """One row: how many of levels 1, 3, 5 and unknown."""
    levels = rows.sparkSession.createDataFrame(list(LEVELS), f"{algorithm} string, level int")
    level = rows.join(F.broadcast(levels), algorithm, "left")
    n = F.coalesce("level", F.lit(0))
    return level.agg(F.count_if(n == 1).alias("level1"), F.count_if(n == 3).alias("level3"), F.count_if(n == 5).alias("level5"), F.count_if(n == 0).alias("unknown"))


def dashboard(h: DataFrame) -> DataFrame:
    """Shares of handshakes: with a post-quantum mechanism, failed, with a post-quantum certificate."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return h.agg(F.count("*").alias("handshakes"), share(F.col("kem").isNotNull()).alias("adoption_rate"), share(~F.col("success")).alias("failure_rate"), share(F.col("pqc_signature")).alias("pqc_certificate_rate"))


def kem_distribution(h: DataFrame) -> DataFrame:
    """Mechanisms offered and selected, counted together."""
    return h.select(F.explode("offers").alias("name")).union(h.where("kem is not null").select("kem")).groupBy("name").agg(F.count("*").alias("n"))


def scan_rules(h: DataFrame) -> DataFrame:
    """A row per finding of a handshake; DOWNGRADE: the server's connection before had a post-quantum mechanism, this one has not."""
    w = Window.partitionBy("server_name").orderBy("us", "seq")
    s = h.withColumn("_before", F.coalesce(F.lag(F.col("kem").isNotNull()).over(w), F.lit(False)))
    rules = (
        ("NO_PQC", F.col("kem").isNull()), ("DOWNGRADE", F.col("kem").isNull() & F.col("_before")), ("FAILED", ~F.col("success")), ("CLASSICAL_SIGNATURE", ~F.col("pqc_signature")), ("OLD_TLS", F.col("tls_version") != "1.3"),
        ("SLOW", F.col("overhead_ms") > 50), ("LARGE_HELLO", F.col("hello_size") > 1400), ("WEAK_RSA", F.col("rsa_bits") < 2048), ("EXPIRING", F.col("days_left") < 14), ("BROKEN_KEM", F.col("kem").isin(*BROKEN)),
    )
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))
    return s.select(*h.columns, F.explode(found).alias("finding"))


def overview(h: DataFrame) -> DataFrame:
    """One row: totals, adoption %, hybrid %, failures % and a risk score of 0 to 100 by their bands."""
    pct = lambda c: F.coalesce(F.avg(c.cast("double")) * 100, F.lit(0.0))
    o = h.agg(F.count("*").alias("total"), pct(F.col("kem").isNotNull()).alias("adoption_pct"), pct(F.col("hybrid")).alias("hybrid_pct"), pct(~F.col("success")).alias("failure_pct"), pct(F.col("pqc_signature")).alias("composite_pct"), F.avg("overhead_ms").alias("overhead_ms"), F.count_if(F.col("fallback").isNotNull()).alias("fallbacks"), F.count_if(F.col("tls_version") != "1.3").alias("old_tls"), F.count_if(F.col("cert_hash") == "SHA1").alias("weak_hash"))
    a, f = F.col("adoption_pct"), F.col("failure_pct")
    risk = F.when(a == 0, 90).when(a < 10, 75).when(a > 80, 15).when(a > 50, 35).otherwise(55) + F.when(f > 20, 20).when(f > 5, 10).otherwise(0)
    return o.withColumn("risk_score", F.least(F.lit(100), risk))


def kem_details(h: DataFrame) -> DataFrame:
    """Per mechanism: count, failures, mean time over successes."""
    return h.where("kem is not null").groupBy("kem").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failures"), F.avg(F.when(F.col("success"), F.col("kem_us"))).alias("mean_us"))


def stage_metrics(h: DataFrame) -> DataFrame:
    """One row: distinct servers, success rate, handshakes without a mechanism at servers that had one once, mean overhead against classical."""
    once = h.where("kem is not null").select("server_name").distinct()
    down = h.where("kem is null").join(once, "server_name", "left_semi").agg(F.count("*").alias("downgraded"))
    base = h.agg(F.countDistinct("server_name").alias("servers"), F.avg(F.col("success").cast("double")).alias("success_rate"), (F.avg(F.when(F.col("kem").isNotNull(), F.col("total_ms"))) - F.avg(F.when(F.col("kem").isNull(), F.col("total_ms")))).alias("overhead_vs_classical"))
    return base.crossJoin(down)  # one row each


def population_findings(h: DataFrame) -> DataFrame:
    """(finding, n) over all handshakes: one aggregate turned into rows, and one row per fallback reason."""
    o = h.agg(F.count("*").alias("t"), F.count_if(~F.col("success")).alias("f"), F.count_if(~F.col("pqc_signature")).alias("s"), F.count_if(F.col("kem") == "ML-KEM-512").alias("l"), F.count_if(F.col("cert_hash") == "SHA1").alias("w"), F.count_if(F.col("tls_version") == "1.2").alias("v"), F.count_if(F.col("kem").isin(*BROKEN)).alias("b"))
    rows = o.selectExpr("stack(6, 'failures', if(f * 10 >= t, f, 0), 'classical signature', s, 'level 1 mechanism', l, 'weak certificate hash', w, 'TLS 1.2', v, 'broken mechanism', b) as (finding, n)").where("n > 0")
    return rows.union(h.where("fallback is not null").groupBy(F.concat(F.lit("fallback: "), F.col("fallback")).alias("finding")).agg(F.count("*").alias("n")))


def compliance(o: DataFrame) -> DataFrame:
    """Five flags from a one-row overview."""
    return o.selectExpr("stack(5, 'mechanisms in use', adoption_pct > 0, 'majority adopted', adoption_pct >= 50, 'hybrid in use', hybrid_pct > 0, 'TLS 1.3 only', old_tls = 0, 'no weak hash', weak_hash = 0) as (flag, met)")


def recommendations(o: DataFrame) -> DataFrame:
    rules = (("raise adoption", F.col("adoption_pct") < 50), ("plan pure mechanisms", F.col("hybrid_pct") > 50), ("add composite certificates", F.col("composite_pct") < 50), ("reduce latency", F.col("overhead_ms") > 10), ("replace weak hashes", F.col("weak_hash") > 0), ("look into fallbacks", F.col("fallbacks") > 0), ("retire TLS 1.2", F.col("old_tls") > 0))
    return o.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))).alias("recommendation"))
