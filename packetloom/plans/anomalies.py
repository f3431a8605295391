"""Queries over baselines (BAS-*, UEBA-*, TRI-*) and detection rules (DET-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import baseline, blocks, detect, filters, folds
from ..operators import projections as prj
from ..sources.adapters import ALERTS, alerts, over_packets, packets, table
from .basic import RULES, rules
from .book import Book

BOOK = Book()
add = BOOK.add
r6 = lambda *names: {n: F.round(n, 6) for n in names}

add(
    "bas01_running_z",
    lambda s, d: baseline.running_z(packets(s, d), ["src"], "length", ["us", "seq"]).withColumns(r6("mean", "z")).select("seq", "mean", "z"),
    over_packets("select seq, round(m, 6) as mean, case when coalesce(v, 0) > 0 then round((length - m) / sqrt(v), 6) else 0.0 end as z from (select seq, length, avg(length) over w as m, var_samp(length) over w as v from packets window w as (partition by src order by us, seq))"),
)
_recursive = "with recursive " + over_packets("", "x")[5:].rsplit(", x", 1)[0]
add(
    "bas02_ewma",
    lambda s, d: blocks.ewma(packets(s, d).select("seq", "src", "us", "length"), "src", "length", 0.3, ["us", "seq"]).select("seq", F.floor(F.col("ewma") * 1000 + 0.0001).alias("ewma_milli")),
    f"{_recursive}, n as (select src, seq, length, row_number() over (partition by src order by us, seq) as i from packets), r as (select src, seq, i, cast(length as double) as e from n where i = 1 union all select n.src, n.seq, n.i, 0.3::double * n.length + 0.7::double * r.e from r join n on n.src = r.src and n.i = r.i + 1) select seq, cast(floor(e * 1000 + 0.0001) as bigint) as ewma_milli from r",
)
add(
    "bas03_seasonal_z",
    lambda s, d: baseline.seasonal_z(packets(s, d), ["sensor"], "length", ["us", "seq"]).select("seq", "slot", F.round("z", 6).alias("z")),
    over_packets("select seq, slot, case when coalesce(v, 0) > 0 then round((length - m) / sqrt(v), 6) else 0.0 end as z from (select seq, length, weekday * 24 + hour as slot, avg(length) over w as m, var_samp(length) over w as v from packets window w as (partition by sensor, weekday * 24 + hour order by us, seq))"),
)
add(
    "bas04_packet_outliers",
    lambda s, d: baseline.packet_outliers(packets(s, d).withColumn("entropy", scalars.byte_entropy(F.encode("summary", "UTF-8"))), ["sensor"], ["us", "seq"], limit=2.5, high_entropy=4.6).where("reason is not null").select("seq", "reason"),
    over_packets("select seq, reason from (select seq, case when abs(g) > 2.5 then 'GLOBAL' when abs(s) > 2.5 then 'SEASONAL' when length > 256 and list_sum(list_transform(list_distinct(string_split(summary, '')), lambda c: -(len(list_filter(string_split(summary, ''), lambda x: x = c)) / length(summary)) * log2(len(list_filter(string_split(summary, ''), lambda x: x = c)) / length(summary)))) > 4.6 then 'ENTROPY' end as reason from (select seq, k, length, summary, case when coalesce(var_samp(length) over w, 0) > 0 then (length - avg(length) over w) / sqrt(var_samp(length) over w) else 0 end as g, case when coalesce(var_samp(length) over v, 0) > 0 then (length - avg(length) over v) / sqrt(var_samp(length) over v) else 0 end as s from packets window w as (partition by sensor order by us, seq), v as (partition by sensor, weekday * 24 + hour order by us, seq))) where reason is not null"),
)
add(
    "bas05_sliding_totals",
    lambda s, d: baseline.sliding_totals(packets(s, d), ["sensor"], 3600).select("seq", "window_packets", "window_bytes"),
    over_packets("select seq, count(*) over w as window_packets, cast(sum(length) over w as bigint) as window_bytes from packets window w as (partition by sensor order by us range between 3600000000 preceding and current row)"),
)


def _host_sql(keys: str) -> str:
    return over_packets(
        f"select seq, array_to_string(reasons, ',') as reasons, case when len(reasons) > 0 then round(least(100.0::double, greatest(10.0::double, 15 * greatest(case when c then greatest(ratio, z) else 0 end, case when o then 3.5 else 0 end, case when f then 3.0 else 0 end, case when v then 2 * length / top else 0 end) + 10 * len(reasons))), 5) else 0.0 end as score "
        "from (select *, list_filter([case when c then 'CONNECTIONS' end, case when o then 'OFF_HOURS' end, case when f then 'FIRST_CONTACT' end, case when v then 'VOLUME' end], lambda x: x is not null) as reasons from "
        "(select *, coalesce(ratio >= 2 or z > 3, false) as c, n > 0 and hour not between 6 and 21 and coalesce(slot_mean < 50, true) as o, n > 0 and known = 0 as f, coalesce(top > 0 and length >= 2 * top, false) as v from "
        "(select *, length / nullif(mean, 0) as ratio, case when coalesce(sd, 0) > 0 then (length - mean) / sd else 0.0 end as z from "
        f"(select *, count(*) over w as n, avg(length) over w as mean, stddev_samp(length) over w as sd, cast(max(length) over w as double) as top, avg(length) over (partition by {keys}, weekday * 24 + hour order by us, seq rows between unbounded preceding and 1 preceding) as slot_mean, count(*) over (partition by {keys}, dst order by us, seq rows between unbounded preceding and 1 preceding) as known from packets window w as (partition by {keys} order by us, seq rows between unbounded preceding and 1 preceding)))))"
    )


for _name, _sensor, _keys in (("bas06_host_scores", None, "src"), ("bas07_sensor_host_scores", "sensor", "sensor, src")):
    add(_name, lambda s, d, c=_sensor: baseline.host_scores(packets(s, d), c).select("seq", F.array_join("reasons", ",").alias("reasons"), F.round("score", 5).alias("score")), _host_sql(_keys))
add("bas08_distinct_counts", lambda s, d: baseline.distinct_counts(packets(s, d)), over_packets("select count(distinct src) as sources, count(distinct dst) as destinations, count(distinct dport) as ports from packets"))

PROFILES = "profiles as (select entity, count(*) filter (o) as packets, count(*) filter (o and (hour >= 22 or hour <= 5)) as quiet, cast(coalesce(sum(length) filter (o), 0) as bigint) as bytes_out, cast(coalesce(sum(length) filter (not o), 0) as bigint) as bytes_in, count(distinct case when o then dst end) as destinations, count(distinct case when o then dport end) as ports from (select src as entity, true as o, * from packets union all select dst, false, * from packets) group by entity)"
add(
    "ueba01_profiles",
    lambda s, d: baseline.entity_profiles(packets(s, d)).select("entity", "packets", "bytes_out", "bytes_in", "destinations", "ports", F.aggregate("activity", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("active")),
    over_packets("select entity, packets, bytes_out, bytes_in, destinations, ports, packets as active from profiles", PROFILES),
)
_share = "case when packets > 0 then quiet / packets else 0.0 end"
_off = f"case when {_share} > 0.2 and packets > 5 then least(100 * ({_share}), 90.0) else 0.0 end"
_exf = "case when bytes_out > 20000 and (case when bytes_in > 0 then bytes_out / bytes_in else 10.0 end) > 3 then least(50.0 * bytes_out / 20000, 95.0) else 0.0 end"
_fan = "case when destinations > 40 then least(40.0 * destinations / 40, 85.0) else 0.0 end"


def _evaluated(s, d):
    return baseline.entity_evaluation(baseline.entity_profiles(packets(s, d)), 20000, 40)


add("ueba02_off_hours", lambda s, d: _evaluated(s, d).select("entity", F.round("off_hours", 6).alias("off_hours")), over_packets(f"select entity, round(({_off})::double, 6) as off_hours from profiles", PROFILES))
add("ueba03_exfiltration", lambda s, d: _evaluated(s, d).select("entity", F.round("exfiltration", 6).alias("exfiltration")), over_packets(f"select entity, round(({_exf})::double, 6) as exfiltration from profiles", PROFILES))
add("ueba04_fan_out", lambda s, d: _evaluated(s, d).select("entity", F.round("fan_out", 6).alias("fan_out")), over_packets(f"select entity, round(({_fan})::double, 6) as fan_out from profiles", PROFILES))
add(
    "ueba05_scores",
    lambda s, d: _evaluated(s, d).select("entity", F.round("score", 6).alias("score"), "suspicious").orderBy(F.desc("score"), "entity"),
    over_packets(f"select entity, round(greatest(({_off})::double, ({_exf})::double, ({_fan})::double), 6) as score, greatest(({_off})::double, ({_exf})::double, ({_fan})::double) >= 50 as suspicious from profiles", PROFILES),
)
SENSITIVE = "dport in (22, 23, 135, 139, 445, 1433, 3306, 3389, 5900)"
add(
    "tri01_triage",
    lambda s, d: baseline.triage(baseline.connection_features(packets(s, d)).join(packets(s, d).select("seq", (F.col("kind") == "error").alias("has_alert"), (F.lit(8.0) - F.col("k") % 3).alias("entropy")), "seq")).select("seq", "score", "band"),
    over_packets(f"select seq, score, case when score <= 20 then 'info' when score <= 45 then 'low' when score <= 70 then 'medium' when score <= 89 then 'high' else 'critical' end as band from (select seq, cast(case when kind = 'error' then 40 else 0 end + case when {SENSITIVE} then 15 else 0 end + case when k % 3 = 0 and length > 200 then 25 else 0 end + case when (flags & 4) <> 0 and (flags & 16) = 0 then 10 else 0 end as int) as score from packets)"),
)
add("tri02_features", lambda s, d: baseline.connection_features(packets(s, d)), over_packets(f"select seq, src, dst, dport, length, {SENSITIVE} as sensitive_port, (flags & 4) <> 0 and (flags & 16) = 0 as bare_reset from packets"))

# Greedy recurrences: the oracle is a recursive query over the rows of a key in order.
_numbered = "n as (select *, row_number() over (partition by {keys} order by us, seq) as i from ({rows}))"


def _cooldown_sql(rows: str, keys: str, us: int, more: str = "") -> str:
    match = " and ".join(f"n.{k} = r.{k}" for k in keys.split(", "))
    return f"{_recursive}{more}, {_numbered.format(keys=keys, rows=rows)}, r as (select {keys}, seq, i, us as last, true as fires from n where i = 1 union all select {', '.join('n.' + k for k in keys.split(', '))}, n.seq, n.i, case when n.us - r.last >= {us} then n.us else r.last end, n.us - r.last >= {us} from r join n on {match} and n.i = r.i + 1)"


add(
    "det01_cooldown",
    lambda s, d: folds.cooldown(packets(s, d).where("kind = 'error'").select("seq", "src", "dst", "us"), ["src", "dst"], 400_000).select("seq"),
    _cooldown_sql("select * from packets where kind = 'error'", "src, dst", 400_000_000_000) + " select seq from r where fires",
)
add(
    "det02_rule_cooldown",
    lambda s, d: folds.cooldown(filters.match_rules(packets(s, d), rules(s, d)).select("seq", "us", "rule_id", "sensor"), ["rule_id", "sensor"], 7200).select("rule_id", "sensor", "seq"),
    _cooldown_sql("select e.seq, e.us, e.sensor, rule_id from packets e join rules on enabled and (rules.kind is null or rules.kind = e.kind) and (rules.protocol is null or rules.protocol = e.protocol) and (rules.dport is null or rules.dport = e.dport)", "rule_id, sensor", 7_200_000_000, f", {RULES}") + " select rule_id, sensor, seq from r where fires",
)
add(
    "det03_traffic_spike",
    lambda s, d: detect.traffic_spikes(packets(s, d), 3600, sigmas=2).select("bucket", "n", "samples", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")),
    over_packets("select bucket, n, samples, round(m, 6) as mean, round(sd, 6) as deviation from (select *, count(*) over w as samples, avg(n) over w as m, stddev_pop(n) over w as sd from (select us // 3600000000 as bucket, count(*) as n from packets group by 1) window w as (order by bucket rows between 59 preceding and current row)) where samples >= 10 and n > m + 2 * sd"),
)
add("det04_error_burst", lambda s, d: detect.error_bursts(packets(s, d), F.col("kind") == "error", 3600), over_packets("select us // 3600000000 as bucket, count(*) as errors from packets where kind = 'error' group by 1 having count(*) > 5"))
for _name, _key in (("det05_new_host", "src"), ("det06_new_protocol", "protocol")):
    add(_name, lambda s, d, c=_key: detect.first_seen(packets(s, d).select("seq", "us", c), c, ["us", "seq"]).select(c, "seq"), over_packets(f"select {_key}, min(seq) as seq from packets group by 1 having min(seq) > (select min(seq) from packets)"))
add(
    "det07_beaconing",
    lambda s, d: detect.beacons(packets(s, d).withColumn("dst", F.col("protocol")), 4, 1e10).select("seq", F.round("mean_gap", 4).alias("mean_gap")),
    over_packets("select seq, round(m, 4) as mean_gap from (select seq, count(gap) over w as c, avg(gap) over w as m, var_pop(gap) over w as v from (select *, (us - lag(us) over (partition by src, protocol order by us, seq)) / 1e6 as gap from packets) window w as (partition by src, protocol order by us, seq rows between 3 preceding and current row)) where c = 4 and v < 1e10 and m > 0.5"),
)
add(
    "det08_capture_beacons",
    lambda s, d: detect.capture_beacons(packets(s, d).withColumn("dst", F.col("protocol")), 8, 0.9).select("src", "dst", "contacts", F.round("interval", 4).alias("interval"), F.round("spread", 6).alias("spread")),
    over_packets("select src, protocol as dst, count(*) as contacts, round(avg(gap), 4) as interval, round(stddev_pop(gap) / avg(gap), 6) as spread from (select *, (us - lag(us) over (partition by src, protocol order by us, seq)) / 1e6 as gap from packets) group by all having count(*) >= 8 and stddev_pop(gap) / avg(gap) < 0.9"),
)
add(
    "det09_outbound_volume",
    lambda s, d: detect.outbound_over(packets(s, d), 5000).select("src", "seq", "sent"),
    over_packets("select src, seq, cast(sent as bigint) as sent from (select *, sum(length) over (partition by src order by us, seq) as sent from packets where k >= 60) where sent > 5000 and sent - length <= 5000"),
)
_rule_sql = {
    "det10_privileged_source": ("privileged_source", "sport < 1024 and dport in (22, 3389, 445)"),
    "det12_dns_tunnel": ("dns_tunnel", "protocol = 'DNS' and length(summary) > 60"),
    "det14_protocol_mismatch": ("protocol_mismatch", "(protocol = 'TLS' and dport = 80) or (protocol = 'HTTP' and dport = 443)"),
    "det15_expired_certificate": ("expired_certificate", "lower(summary) like '%certificate expired%'"),
    "det15_weak_cipher": ("weak_cipher", "regexp_matches(upper(summary), 'RC4|3DES|NULL|EXPORT')"),
    "det15_no_pqc": ("no_pqc", "dport = 443 and not regexp_matches(lower(summary), 'mlkem|kyber|pqc')"),
    "det25_cleartext_credentials": ("cleartext_credentials", "protocol = 'HTTP' and kind = 'signup'"),
}


def _varied(p):
    """Packets whose ports and texts also meet the rules of one packet."""
    return p.withColumns({"sport": F.when(F.col("k") % 11 == 0, 900).otherwise(F.col("sport")), "dport": F.when(F.col("k") % 13 == 0, 443).otherwise(F.col("dport")), "summary": F.concat("summary", F.when(F.col("k") % 17 == 0, " certificate expired RC4-SHA long text that goes on and on for sixty").otherwise(""))})


VARIED = "varied as (select * replace (case when k % 11 = 0 then 900 else sport end as sport, case when k % 13 = 0 then 443 else dport end as dport, concat(summary, case when k % 17 = 0 then ' certificate expired RC4-SHA long text that goes on and on for sixty' else '' end) as summary) from packets)"
for _name, (_rule, _sql) in _rule_sql.items():
    add(_name, lambda s, d, c=_rule: _varied(packets(s, d)).where(detect.PACKET_RULES[c]()).groupBy("protocol").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")), over_packets(f"select protocol, count(*) as n, cast(sum(seq) as bigint) as seq_sum from varied where {_sql} group by protocol", VARIED))
add(
    "det11_lateral_anchored",
    lambda s, d: folds.anchored_distinct(packets(s, d).select("seq", "src", "dst", "us"), "src", "dst", 5, 100_000).select("seq"),
    f"{_recursive}, n as (select *, row_number() over (partition by src order by us, seq) as i from packets), r as (select src, seq, i, us as start, [dst] as seen, false as fires from n where i = 1 union all select n.src, n.seq, n.i, case when n.us - r.start > 100000000000 then n.us else r.start end, case when n.us - r.start > 100000000000 then [n.dst] else list_distinct(list_append(r.seen, n.dst)) end, case when n.us - r.start > 100000000000 then false else not list_contains(r.seen, n.dst) and len(r.seen) >= 4 end from r join n on n.src = r.src and n.i = r.i + 1) select seq from r where fires",
)
add("det11_lateral_windows", lambda s, d: detect.fan_out_windows(packets(s, d), 5, 100_000), over_packets("select src, us // 100000000000 as bucket, count(distinct dst) as destinations from packets group by all having count(distinct dst) >= 5"))
add(
    "det13_dga",
    lambda s, d: packets(s, d).where("kind <> 'click'").withColumn("summary", F.when(F.col("k") % 9 == 0, F.concat(F.lit("Query "), F.md5("summary"), F.lit("ghjkmnpqrstuvwxyz"))).otherwise(F.col("summary"))).where(detect.PACKET_RULES["dga"]()).groupBy("protocol").agg(F.count("*").alias("n")),
    over_packets("select protocol, count(*) as n from (select p.protocol, p.seq, -sum((c / t) * log2(c / t)) as h from (select protocol, seq, ch, count(*) as c, sum(count(*)) over (partition by seq) as t from (select protocol, seq, unnest(string_split(case when k % 9 = 0 then concat(md5(summary), 'ghjkmnpqrstuvwxyz') else list_extract(string_split(summary, ' '), -1) end, '')) as ch from packets where kind <> 'click') group by protocol, seq, ch) p group by p.protocol, p.seq) where h > 4.2 group by protocol"),
)
add(
    "det16_threshold_with_reset",
    lambda s, d: folds.threshold_alerts(packets(s, d).select("seq", "src", "us"), ["src"], 5, 86400).select("seq"),
    f"{_recursive}, n as (select *, row_number() over (partition by src order by us, seq) as i from packets), r as (select src, seq, i, [us] as q, false as fires from n where i = 1 union all select n.src, n.seq, n.i, case when len(list_filter(r.q, lambda x: n.us - x <= 86400000000)) + 1 >= 5 then cast([] as bigint[]) else list_append(list_filter(r.q, lambda x: n.us - x <= 86400000000), n.us) end, len(list_filter(r.q, lambda x: n.us - x <= 86400000000)) + 1 >= 5 from r join n on n.src = r.src and n.i = r.i + 1) select seq from r where fires",
)
add("det16_threshold_sliding", lambda s, d: detect.sliding_threshold(packets(s, d), ["src"], 5, 86400).select("seq", "matches"), over_packets("select seq, m as matches from (select seq, count(*) over (partition by src order by us range between 86400000000 preceding and current row) as m from packets) where m >= 5"))
add(
    "det17_timed_threshold",
    lambda s, d: detect.timed_threshold(packets(s, d), ["src"], 6, 86400, "22:00", "06:00", F.col("hour") * 60).select("seq"),
    over_packets("select seq from (select seq, hour, count(*) over (partition by src order by us range between 86400000000 preceding and current row) as m from packets) where m >= case when hour >= 22 or hour <= 6 then 3 else 6 end"),
)
add(
    "det18_signature_deduped",
    lambda s, d: folds.cooldown(packets(s, d).where(F.col("summary").contains("item/1")).select("seq", "src", "us"), ["src"], 86400).select("seq"),
    _cooldown_sql("select * from packets where contains(summary, 'item/1')", "src", 86_400_000_000) + " select seq from r where fires",
)
add(
    "det19_correlation",
    lambda s, d: detect.correlated(packets(s, d), ["item/3", "password", "purchase"]),
    over_packets("select src, greatest(min(us) filter (contains(summary, 'item/3')), min(us) filter (contains(summary, 'password')), min(us) filter (contains(summary, 'purchase'))) as us from packets group by src having count(*) filter (contains(summary, 'item/3')) > 0 and count(*) filter (contains(summary, 'password')) > 0 and count(*) filter (contains(summary, 'purchase')) > 0"),
)
add(
    "det19_correlation_repeats",
    lambda s, d: detect.correlations(packets(s, d), ["GET /item", "password", "NXDOMAIN"], cooldown=86400).select("src", "seq"),
    f"{_recursive}, n as (select src, us, seq, m, row_number() over (partition by src order by us, seq) as i from (select src, us, seq, "
    "case when contains(summary, 'GET /item') then 1 else 0 end + case when contains(summary, 'password') then 2 else 0 end + case when contains(summary, 'NXDOMAIN') then 4 else 0 end as m from packets) where m > 0), "
    "r as (select src, seq, i, m as seen, cast(null as bigint) as last, false as fires from n where i = 1 "
    "union all select src, seq, i, case when f then 0 else s end, case when f then us else last end, f from "
    "(select *, s = 7 and (last is null or us - last >= 86400000000) as f from (select n.src, n.seq, n.i, n.us, r.last, r.seen | n.m as s from r join n on n.src = r.src and n.i = r.i + 1))) "
    "select src, seq from r where fires",
)
add(
    "det20_absence",
    lambda s, d: detect.absences(packets(s, d), F.col("kind") == "view", "src", 4 * 86400).select("seq", "silent_us"),
    over_packets("select seq, silent_us from (select seq, coalesce(lead(us) over (partition by src order by us, seq), last) - us as silent_us from (select *, max(us) over (partition by src) as last from packets) where kind = 'view') where silent_us > 345600000000"),
)
add("det21_distributed_scan", lambda s, d: detect.distinct_over(packets(s, d), ["dst"], "sensor", 3), over_packets("select dst, count(distinct sensor) as values from packets group by dst having count(distinct sensor) >= 3"))
add(
    "det22_rule_batch",
    lambda s, d: folds.cooldown(filters.match_rules(packets(s, d), rules(s, d)).select("seq", "us", "rule_id", "sensor"), ["rule_id", "sensor"], 3600).groupBy("rule_id").agg(F.count("*").alias("alerts")),
    _cooldown_sql("select e.seq, e.us, e.sensor, rule_id from packets e join rules on enabled and (rules.kind is null or rules.kind = e.kind) and (rules.protocol is null or rules.protocol = e.protocol) and (rules.dport is null or rules.dport = e.dport)", "rule_id, sensor", 3_600_000_000, f", {RULES}") + " select rule_id, count(*) as alerts from r where fires group by rule_id",
)
add("det23_port_scan", lambda s, d: detect.distinct_over(packets(s, d), ["src", "kind"], "dport", 8), over_packets("select src, kind, count(distinct dport) as values from packets group by all having count(distinct dport) >= 8"))
add("det24_host_sweep", lambda s, d: detect.distinct_over(packets(s, d), ["src"], "dst", 40), over_packets("select src, count(distinct dst) as values from packets group by src having count(distinct dst) >= 40"))
add(
    "det26_odd_domain",
    lambda s, d: packets(s, d).where("kind = 'view'").withColumn("domain", F.when(F.col("k") % 6 == 0, F.concat(F.lit("a123456789"), prj.summary_domain())).otherwise(prj.summary_domain())).where(detect.odd_domain(F.col("domain"))).groupBy("domain").agg(F.count("*").alias("n")),
    over_packets("select concat('a123456789a', k, '.example', k % 5, '.com') as domain, count(*) as n from packets where kind = 'view' and k % 6 = 0 group by k"),
)


def _uploads(s, d):
    from ..operators import flows

    f = flows.flow_table(packets(s, d))
    host = lambda c: F.regexp_replace(c, ":[0-9]*$", "")
    scope = lambda c: scalars.address_scope(host(F.col(c)))
    return f.where((scope("client") == "private") & (scope("server") == "public") & (F.col("sent_bytes") >= 900)).select("client", "server", "sent_bytes").orderBy(F.desc("sent_bytes"), "client", "server").limit(5)


add(
    "det27_large_upload",
    _uploads,
    over_packets("select concat(src, ':', sport) as client, concat(dst, ':', dport) as server, cast(sum(length) as bigint) as sent_bytes from packets where k >= 60 group by all having sum(length) >= 900 order by sent_bytes desc, client, server limit 5"),
)
add(
    "det28_resets",
    lambda s, d: packets(s, d).groupBy("src").agg(F.count_if(scalars.has_token(F.col("summary"), "RST") | F.col("summary").contains("Malformed")).alias("bad")).where("bad >= 15"),
    over_packets("select src, count(*) as bad from packets where kind = 'error' group by src having count(*) >= 15"),
)


def _insights(s, d):
    p = packets(s, d)
    parts = [
        detect.distinct_over(p, ["src"], "dst", 40).select(F.lit(8).alias("severity"), F.lit("host sweep").alias("finding"), F.col("src").alias("who")),
        p.where(detect.PACKET_RULES["cleartext_credentials"]()).groupBy("src").agg(F.count("*").alias("n")).select(F.lit(9).alias("severity"), F.lit("cleartext credentials").alias("finding"), F.col("src").alias("who")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("severity"), "finding", "who")


add("det29_insights", _insights, over_packets("select 8 as severity, 'host sweep' as finding, src as who from packets group by src having count(distinct dst) >= 40 union all select distinct 9, 'cleartext credentials', src from packets where protocol = 'HTTP' and kind = 'signup'"))
SIGNATURES = [("traversal", "../.."), ("card-test", "4111"), ("common", " the "), ("spanish", " el ")]
add(
    "det30_payload_signatures",
    lambda s, d: detect.signature_hits(table(s, d, "documents").select("doc_id", "text"), s.createDataFrame(SIGNATURES, "name string, words string"), "text", "doc_id").select("doc_id", "name"),
    "select doc_id, name from documents, (values ('traversal', '../..'), ('card-test', '4111'), ('common', ' the '), ('spanish', ' el ')) v(name, words) where contains(lower(text), words)",
)
add(
    "det31_lockout",
    lambda s, d: folds.lockouts(packets(s, d).select("seq", "src", "us", (F.col("kind") == "purchase").alias("success")), "src", 5, 900).select("seq", "failed", "locked_until"),
    over_packets("select seq, failed, us + 900000000 as locked_until from (select seq, us, ok, count(*) filter (not ok) over (partition by src, island order by us, seq) as failed from (select *, kind = 'purchase' as ok, count(*) filter (kind = 'purchase') over (partition by src order by us, seq) as island from packets)) where not ok and failed >= 5"),
)
STAGES = [("scan", "kind = 'view'"), ("access", "kind = 'signup'"), ("move", "kind = 'error'"), ("take", "kind = 'purchase'")]
add(
    "det32_attack_chain",
    lambda s, d: detect.attack_chains(packets(s, d), [(n, F.expr(c)) for n, c in STAGES], "src", "protocol", 20 * 86400),
    over_packets("select src, protocol, (case when a is not null then 1 else 0 end + case when b is not null then 1 else 0 end + case when c is not null then 1 else 0 end + case when e is not null then 1 else 0 end) / 4 as completion, (a is not null and b is not null and c is not null and e is not null) as confirmed, coalesce(a <= b and b <= c and c <= e and e - a <= 1728000000000, false) as in_order from (select src, protocol, min(us) filter (kind = 'view') as a, min(us) filter (kind = 'signup') as b, min(us) filter (kind = 'error') as c, min(us) filter (kind = 'purchase') as e from packets group by all) where a is not null or b is not null or c is not null or e is not null"),
)
AS_OF = 870000000000000
add(
    "det33_escalations",
    lambda s, d: detect.escalations(alerts(s, d).withColumn("created_us", F.lit(AS_OF) - (F.col("alert_id") % 150) * 60_000_000), AS_OF).select("alert_id", "step", "after_min"),
    f"with {ALERTS} select alert_id, step, after_min from alerts, (values (1, 15), (2, 45), (3, 105)) v(step, after_min) where status = 'open' and after_min <= alert_id % 150",
)
