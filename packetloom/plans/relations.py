"""Queries over joins (JN-*) and flows (FLOW-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows, folds, joins
from ..operators import projections as prj
from ..sources.adapters import ALERTS, HEARTBEATS, alerts, heartbeats, over_packets, packets, table
from .basic import NAMES, _names
from .book import Book

BOOK = Book()
add = BOOK.add
LIST = "listed as (select concat('192.168.1.', cast(doc_id % 60 as string)) as value, concat('A', cast(doc_id % 100 as string), '.example', cast(doc_id % 5 as string), '.com') as domain from labels where toxic = 1)"


def listed(s, d):
    return table(s, d, "labels").where("toxic = 1").selectExpr("concat('192.168.1.', cast(doc_id % 60 as string)) as value", "concat('A', cast(doc_id % 100 as string), '.example', cast(doc_id % 5 as string), '.com') as domain")


add(
    "jn01_ip_indicators",
    lambda s, d: joins.ip_indicators(packets(s, d), listed(s, d)).groupBy("sid", "value").agg(F.count("*").alias("n")),
    over_packets("select 200002 as sid, dst as value, count(*) as n from packets where dst in (select value from listed) group by dst", LIST),
)
add(
    "jn02_domain_indicators",
    lambda s, d: joins.domain_indicators(packets(s, d).where("kind = 'view'"), listed(s, d).select(F.col("domain").alias("value")), prj.summary_domain()).groupBy("sid", "domain").agg(F.count("*").alias("n")),
    over_packets("select 300001 as sid, domain, count(*) as n from (select concat('a', k, '.example', k % 5, '.com') as domain from packets where kind = 'view') where domain in (select lower(domain) from listed) group by domain", LIST),
)
IDS = "ids as (select min(p_partkey) as sid, case when p_partkey % 3 = 0 then 'HTTP' end as protocol, case when p_partkey % 4 = 1 then '10.1.0.5' end as src_ip, cast(null as string) as dst_ip, case p_partkey % 5 when 0 then 80 when 1 then 53 end as dst_port, case when p_partkey % 2 = 0 then 'item' end as content from part group by all)"


def ids(s, d):
    """The different signatures of the whole table, each under its first number."""
    every = table(s, d, "part").selectExpr("p_partkey as sid", "case when p_partkey % 3 = 0 then 'HTTP' end as protocol", "case when p_partkey % 4 = 1 then '10.1.0.5' end as src_ip", "cast(null as string) as dst_ip", "case p_partkey % 5 when 0 then 80 when 1 then 53 end as dst_port", "case when p_partkey % 2 = 0 then 'item' end as content")
    return every.groupBy("protocol", "src_ip", "dst_ip", "dst_port", "content").agg(F.min("sid").alias("sid"))


add(
    "jn03_ids_rules",
    lambda s, d: joins.ids_matches(packets(s, d), ids(s, d)).groupBy("sid").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")),
    over_packets("select sid, count(*) as n, cast(sum(seq) as bigint) as seq_sum from packets p join ids r on (r.protocol is null or r.protocol = p.protocol) and (r.src_ip is null or r.src_ip = p.src) and (r.dst_ip is null or r.dst_ip = p.dst) and (r.dst_port is null or r.dst_port = p.dport) and (r.content is null or contains(p.summary, r.content)) group by sid", IDS),
)
add("jn04_flagged", lambda s, d: joins.flagged(packets(s, d), listed(s, d)).groupBy("src").agg(F.count("*").alias("n")), over_packets("select src, count(*) as n from packets where dst in (select value from listed) or src in (select value from listed) group by src", LIST))
add(
    "jn05_event_sensors",
    lambda s, d: joins.with_name(packets(s, d).withColumn("sid", F.col("k").cast("bigint")), table(s, d, "supplier"), "sid", "s_suppkey", "s_name", "hostname").groupBy("hostname").agg(F.count("*").alias("n")),
    over_packets("select s_name as hostname, count(*) as n from packets left join supplier on s_suppkey = k group by 1"),
)
add(
    "jn06_alert_rules",
    lambda s, d: joins.with_name(alerts(s, d), table(s, d, "part"), "rule_id", "p_partkey", "p_name", "rule_name").groupBy("rule_name", "severity").agg(F.count("*").alias("n")),
    f"with {ALERTS} select p_name as rule_name, severity, count(*) as n from alerts left join part on p_partkey = rule_id group by 1, 2",
)


def _detail(s, d):
    a = alerts(s, d).selectExpr("alert_id", "rule_id", "alert_id % 9000 as event_id", "sensor_id as created_by", "case when status <> 'open' then sensor_id + 1 end as acknowledged_by", "case when status = 'resolved' then sensor_id + 2 end as resolved_by")
    rules = table(s, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("rule_name"))
    events = table(s, d, "events").select("event_id", F.col("event_type").alias("event_title"))
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return joins.alert_detail(a, rules, events, users).select("alert_id", "rule_name", "event_title", "created_by_name", "acknowledged_by_name", "resolved_by_name")


add(
    "jn07_alert_detail",
    _detail,
    f"with {ALERTS} select alert_id, p_type as rule_name, event_type as event_title, a.c_name as created_by_name, b.c_name as acknowledged_by_name, c.c_name as resolved_by_name from alerts left join part on p_partkey = rule_id left join events on event_id = alert_id % 9000 left join customer a on a.c_custkey = sensor_id left join customer b on status <> 'open' and b.c_custkey = sensor_id + 1 left join customer c on status = 'resolved' and c.c_custkey = sensor_id + 2",
)
add(
    "jn08_notes",
    lambda s, d: joins.with_name(table(s, d, "conversations").where("role = 'user'").withColumn("user_id", F.col("conv_id") % 100), table(s, d, "customer"), "user_id", "c_custkey", "c_name", "author").select("conv_id", "turn", "author").orderBy("conv_id", "turn"),
    "select conv_id, turn, c_name as author from conversations left join customer on c_custkey = conv_id % 100 where role = 'user'",
)
add(
    "jn09_case_alerts",
    lambda s, d: joins.linked(alerts(s, d), table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("case_id")), "alert_id", "l_orderkey").where("case_id = 7").select("alert_id", "case_id", "severity"),
    f"with {ALERTS} select distinct alert_id, 7 as case_id, severity from alerts join lineitem on l_orderkey = alert_id where l_partkey % 50 = 7".replace("7 as case_id", "cast(7 as bigint) as case_id"),
)
add(
    "jn10_custody",
    lambda s, d: table(s, d, "events").selectExpr("event_id as log_id", "user_id as evidence_id").join(table(s, d, "supplier").selectExpr("s_suppkey as evidence_id", "s_nationkey as case_id"), "evidence_id").where("case_id = 3").select("log_id", "evidence_id"),
    "select event_id as log_id, user_id as evidence_id from events join supplier on s_suppkey = user_id where s_nationkey = 3",
)
add(
    "jn11_latest_heartbeat",
    lambda s, d: joins.with_latest(table(s, d, "supplier").select(F.col("s_suppkey").alias("sensor_id"), "s_name"), heartbeats(s, d), "sensor_id", ["us", "seq"]).select("sensor_id", "s_name", "us", "seq", "bps"),
    f"with {HEARTBEATS} select s_suppkey as sensor_id, s_name, us, seq, bps from supplier left join (select *, row_number() over (partition by sensor_id order by us desc, seq desc) as r from heartbeats) on sensor_id = s_suppkey and r = 1",
)


def _impact(s, d):
    assets = table(s, d, "supplier").selectExpr("case when s_suppkey % 2 = 0 then concat('192.168.1.', cast(s_suppkey % 60 as string)) end as ip", "concat('Host', cast(s_suppkey as string)) as hostname", "cast(1 + s_suppkey % 4 as int) as tier", "concat('D', cast(s_nationkey as string)) as department", "'SECRET' as classification")
    rows = packets(s, d).withColumn("host", F.concat(F.lit("HOST"), F.col("k").cast("string")))
    return joins.asset_impact(rows, assets, "dst", "host").groupBy("asset", "criticality", "classification", "financial_impact").agg(F.count("*").alias("n"))


add(
    "jn12_asset_impact",
    _impact,
    over_packets("select coalesce(a.hostname, b.hostname, 'HOST' || k) as asset, case when coalesce(a.tier, b.tier) is null then 'UNKNOWN' else concat('Tier ', coalesce(a.tier, b.tier), ' (', coalesce(a.department, b.department), ')') end as criticality, case when coalesce(a.tier, b.tier) is null then 'INTERNAL' else 'SECRET' end as classification, case when coalesce(a.tier, b.tier) <= 2 then 'High' when coalesce(a.tier, b.tier) = 4 then 'Low' else 'Medium' end as financial_impact, count(*) as n from packets left join (select ip, unnest(min(struct_pack(hostname := hostname, tier := tier, department := department))) from assets where ip is not null group by ip) a on a.ip = dst left join assets b on b.hostname = 'Host' || k group by all", "assets as (select case when s_suppkey % 2 = 0 then concat('192.168.1.', s_suppkey % 60) end as ip, concat('Host', s_suppkey) as hostname, 1 + s_suppkey % 4 as tier, concat('D', s_nationkey) as department from supplier)"),
)


def _answers(s, d):
    return packets(s, d).where("kind = 'view'").selectExpr("dst as ip", "concat('a', k, '.example', cast(seq % 9 as string)) as name", "us", "seq")


add(
    "jn13_name_last_wins",
    lambda s, d: joins.learned_names(_answers(s, d)),
    over_packets("select dst as ip, arg_max(concat('a', k, '.example', seq % 9), seq) as name from packets where kind = 'view' group by dst"),
)
add(
    "jn13_name_as_of",
    lambda s, d: joins.as_of(packets(s, d).where("kind = 'error'").select("seq", "us", F.col("dst").alias("ip")), _answers(s, d), "ip", "name").select("seq", "ip", "name"),
    over_packets("select p.seq, p.dst as ip, a.name from (select * from packets where kind = 'error') p asof left join (select dst as ip, concat('a', k, '.example', seq % 9) as name, us from packets where kind = 'view') a on a.ip = p.dst and p.us >= a.us"),
)


def _identity(s, d):
    rows = table(s, d, "supplier").selectExpr("s_suppkey", "concat('AA-BB-', cast(10 + s_suppkey % 27 as string), '-00-00-01') as mac", "concat('10.0.', cast(floor(s_suppkey * 17 / 250) as string), '.', cast(s_suppkey * 17 % 250 as string)) as ip")
    vendors = table(s, d, "nation").selectExpr("concat('AA:BB:', cast(10 + n_nationkey as string)) as oui", "n_name as vendor")
    users = table(s, d, "customer").selectExpr("concat('10.0.', cast(floor(c_custkey / 250) as string), '.', cast(c_custkey % 250 as string)) as ip", "c_name as user")
    return joins.identity(rows, vendors, users, "mac", "ip").select("s_suppkey", "vendor", "user")


add("jn14_identity", _identity, "select s_suppkey, n_name as vendor, c_name as user from supplier left join nation on n_nationkey = s_suppkey % 27 left join customer on c_custkey = s_suppkey * 17")


def _geo(s, d):
    ranges = table(s, d, "nation").selectExpr("3232235776 + n_nationkey * 3 as low", "3232235776 + n_nationkey * 3 + 2 as high", "n_name as country")
    return joins.geo(packets(s, d), ranges).groupBy("country").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


add("jn15_geo", _geo, over_packets("select n_name as country, count(*) as n, cast(sum(seq) as bigint) as seq_sum from packets left join nation on k < 60 and n_nationkey = k // 3 group by 1"))


def _enriched(s, d):
    rows = joins.asset_impact(packets(s, d).withColumn("host", F.col("dst")), table(s, d, "supplier").selectExpr("concat('192.168.1.', cast(s_suppkey as string)) as ip", "s_name as hostname", "1 as tier", "'D' as department", "'SECRET' as classification"), "dst", "host")
    named = joins.with_name(rows, _names(s, d), "src", "ip", "name", "src_name")
    sev = prj.expert_severity()
    return named.select("seq", sev.alias("severity"), prj.severity_score(sev).alias("score"), "src_name", "asset", "criticality")


add(
    "jn16_enriched_row",
    _enriched,
    over_packets("select seq, case when kind = 'error' then 'Error' when kind = 'view' then 'Warning' when kind = 'purchase' then 'Note' else 'Chat' end as severity, case when kind = 'error' then 9 when kind = 'view' then 6 when kind = 'purchase' then 3 else 0 end as score, name as src_name, coalesce(s_name, dst) as asset, case when s_name is not null then 'Tier 1 (D)' else 'UNKNOWN' end as criticality from packets left join names on ip = src left join supplier on s_suppkey = k and k < 60", NAMES),
)
add(
    "jn17_enriched_event",
    lambda s, d: joins.with_name(packets(s, d), _names(s, d), "src", "ip", "name", "src_name").select("seq", F.to_json(F.struct(F.struct(F.col("src").alias("ip"), F.col("src_name").alias("name")).alias("actor"), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port")).alias("target"))).alias("event")),
    over_packets("select seq, concat('{\"actor\":{\"ip\":\"', src, '\"', case when name is not null then concat(',\"name\":\"', name, '\"') else '' end, '},\"target\":{\"ip\":\"', dst, '\",\"port\":', dport, '}}') as event from packets left join names on ip = src", NAMES),
)
add(
    "jn18_earlier_alerts",
    lambda s, d: joins.earlier_alerts(alerts(s, d), "source_ip", "created_us").select("alert_id", "earlier"),
    f"with {ALERTS} select alert_id, count(*) over (partition by source_ip order by created_us range between 86400000000 preceding and current row) - 1 as earlier from alerts",
)


SPLIT = 1705363200000000  # 2024-01-16, the middle of the tables' month


def _half(s, d, cond):
    return packets(s, d).where(cond).groupBy("src", "protocol").agg(F.sum("length").alias("bytes"))


add(
    "jn19_snapshot_diff",
    lambda s, d: joins.snapshot_diff(_half(s, d, f"us < {SPLIT}"), _half(s, d, f"us >= {SPLIT}"), ["src", "protocol"], "bytes"),
    over_packets("select coalesce(b.src, a.src) as src, coalesce(b.protocol, a.protocol) as protocol, b.bytes as before_value, a.bytes as after_value, case when b.bytes is null then 'NEW' when a.bytes is null then 'GONE' else 'BOTH' end as state, coalesce(a.bytes, 0) - coalesce(b.bytes, 0) as delta from (select src, protocol, cast(sum(length) as bigint) as bytes from packets where us < 1705363200000000 group by all) b full join (select src, protocol, cast(sum(length) as bigint) as bytes from packets where us >= 1705363200000000 group by all) a on a.src = b.src and a.protocol = b.protocol"),
)

# Flows: an end's order key is its address as a number; here 10.x < 93.x < 192.x < IPv6.
ENDS = "ends as (select *, concat(src, ':', sport) as a, concat(dst, ':', dport) as b, case when protocol in ('DNS', 'NTP') then 'udp' else 'tcp' end as transport from packets)"
add("flow01_keys", lambda s, d: flows.with_flow_key(packets(s, d)).groupBy("flow_lo", "flow_hi", "transport").agg(F.count("*").alias("n")), over_packets("select a as flow_lo, b as flow_hi, transport, count(*) as n from ends group by all", ENDS))


def _both_ways(s, d):
    """Every third packet goes back from server to client."""
    p = packets(s, d)
    back = F.col("seq") % 3 == 1
    swap = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    return p.select("seq", "us", swap("src", "dst").alias("src"), swap("dst", "src").alias("dst"), swap("sport", "dport").alias("sport"), swap("dport", "sport").alias("dport"), "protocol", "length", "summary", "flags", "k", "kind")


add(
    "flow02_flow_table",
    lambda s, d: flows.flow_table(_both_ways(s, d)).drop("transport"),
    over_packets("select a as flow_lo, b as flow_hi, count(*) as packets, cast(sum(length) as bigint) as bytes, min(us) as start_us, max(us) as end_us, any_value(protocol) as protocol, arg_max(summary, seq) as last_summary, min(seq) as first_seq, case when arg_min(back, seq) then b else a end as client, case when arg_min(back, seq) then a else b end as server, count(*) filter (back = first_back) as sent_packets, cast(coalesce(sum(length) filter (back = first_back), 0) as bigint) as sent_bytes, count(*) filter (back <> first_back) as received_packets, cast(coalesce(sum(length) filter (back <> first_back), 0) as bigint) as received_bytes from (select *, seq % 3 = 1 as back, first_value(seq % 3 = 1) over (partition by a, b, transport order by seq) as first_back from ends) group by a, b, transport", ENDS),
)
add(
    "flow03_durations",
    lambda s, d: flows.with_duration(flows.flow_table(packets(s, d))).select("client", "server", "duration_us", "byte_count"),
    over_packets("select a as client, b as server, max(us) - min(us) as duration_us, cast(sum(length) as bigint) as byte_count from ends group by a, b, transport", ENDS),
)


def _segments(s, d):
    return packets(s, d).selectExpr("seq", "src", "cast(k / 10 as int) as port", "cast(1000 + (seq * 37 % 50) * 100 as bigint) as tcp_seq", "cast(seq % 2 * 100 as int) as payload_len", "cast(seq % 4 as int) as ack", "1 as win", "summary")


SEGMENTS = "segments as (select seq, src, cast(floor(k / 10) as int) as port, cast(1000 + (seq * 37 % 50) * 100 as bigint) as tcp_seq, cast(seq % 2 * 100 as int) as payload_len, cast(seq % 4 as int) as ack, 1 as win, summary from packets)"
add(
    "flow04_tcp_tags",
    lambda s, d: flows.tcp_tags(_segments(s, d), ["src", "port"]).select("seq", "tag"),
    over_packets("select seq, case when payload_len > 0 and seen > 0 then 'Retransmission' when payload_len > 0 and tcp_seq < top then 'Out-of-Order' when dup then concat('Dup ACK #', count(*) filter (dup) over (partition by src, port, island order by seq)) end as tag from (select *, count(*) filter (not dup) over (partition by src, port order by seq) as island from (select *, count(*) filter (payload_len > 0) over (partition by src, port, tcp_seq order by seq rows between unbounded preceding and 1 preceding) as seen, max(tcp_seq) over (partition by src, port order by seq rows between unbounded preceding and 1 preceding) as top, coalesce(payload_len = 0 and lag(payload_len) over w = 0 and lag(ack) over w = ack, false) as dup from segments window w as (partition by src, port order by seq)))", SEGMENTS),
)
add(
    "flow05_flow_experts",
    lambda s, d: flows.flow_experts(packets(s, d), ["src", "dst"], 0.1, 5e9).select("src", "dst", "packets", "retransmissions", F.round("mean_gap_ms", 4).alias("mean_gap_ms"), F.round("loss_pct", 6).alias("loss_pct"), F.round("health", 6).alias("health")),
    over_packets("select src, dst, packets, r as retransmissions, round(g, 4) as mean_gap_ms, round(r * 100.0::double / packets, 6) as loss_pct, round(100.0::double - least(5 * (r * 100.0::double / packets), 50.0), 6) as health from (select src, dst, count(*) as packets, count(*) filter (kind = 'error') as r, avg(case when gap > 0.1 and gap < 5e9 then gap end) as g from (select *, (us - lag(us) over (partition by src, dst order by us, seq)) / 1000.0::double as gap from packets) group by src, dst)"),
)
add(
    "flow06_follow",
    lambda s, d: flows.follow(packets(s, d), 25).select("seq", "direction", "total_bytes"),
    over_packets("select seq, 'out' as direction, cast(sum(length) over (order by us, seq) as bigint) as total_bytes from ends where (a, b, transport) = (select (a, b, transport) from ends where seq = 25)", ENDS),
)
add(
    "flow07_reassembly",
    lambda s, d: flows.reassemble(_segments(s, d).where("payload_len > 0"), ["src", "port"], data="summary").select("src", "port", "segments", F.md5("stream").alias("digest")),
    over_packets("select src, port, count(*) as segments, md5(string_agg(s, '' order by tcp_seq)) as digest from (select src, port, tcp_seq, arg_max(summary, seq) as s from segments where payload_len > 0 group by all) group by src, port", SEGMENTS),
)
add("flow08_timeline", lambda s, d: flows.timeline(packets(s, d)), over_packets("select us, seq, src, dst, protocol, summary from packets"))
add(
    "flow09_forensic_window",
    lambda s, d: flows.around(packets(s, d), packets(s, d).where("kind = 'error' and k = 7").selectExpr("seq as trigger_id", "us as t_us"), 7200, 3600).groupBy("trigger_id").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")),
    over_packets("select t.seq as trigger_id, count(*) as n, cast(sum(p.length) as bigint) as bytes from packets t join packets p on p.us between t.us - 7200000000 and t.us + 3600000000 where t.kind = 'error' and t.k = 7 group by t.seq"),
)
add(
    "flow10_pre_trigger",
    lambda s, d: flows.around(packets(s, d), packets(s, d).groupBy().agg(F.max("us").alias("t_us")).selectExpr("cast(0 as bigint) as trigger_id", "t_us"), 86400, 0).select("seq", "us"),
    over_packets("select seq, us from packets where us >= (select max(us) - 86400000000 from packets)"),
)
add(
    "flow11_merge",
    lambda s, d: flows.merge_captures([packets(s, d).where("seq % 2 = 0").select("us", "seq", "src"), packets(s, d).where("seq % 2 = 1").select("us", "seq", "src")]),
    over_packets("select us, seq, src, cast(seq % 2 as int) as file_idx from packets"),
)
add("flow12_split_packets", lambda s, d: flows.split_by_packets(packets(s, d), ["sensor"], 100).groupBy("sensor", "chunk").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")), over_packets("select sensor, cast(chunk as bigint) as chunk, count(*) as n, min(seq) as first_seq from (select *, (row_number() over (partition by sensor order by seq) - 1) // 100 as chunk from packets) group by all"))
_recursive = "with recursive " + over_packets("", "x")[5:].rsplit(", x", 1)[0]
add(
    "flow13_split_seconds",
    lambda s, d: folds.split_greedy(packets(s, d).select("seq", "src", "us", "length"), ["src"], 86400, "time").groupBy("src", "chunk").agg(F.count("*").alias("n")),
    f"{_recursive}, n as (select src, us, row_number() over (partition by src order by seq) as i from packets), r as (select src, i, us as start, cast(0 as bigint) as chunk from n where i = 1 union all select n.src, n.i, case when n.us - r.start >= 86400000000 then n.us else r.start end, case when n.us - r.start >= 86400000000 then r.chunk + 1 else r.chunk end from r join n on n.src = r.src and n.i = r.i + 1) select src, chunk, count(*) as n from r group by all",
)
add(
    "flow14_split_bytes",
    lambda s, d: folds.split_greedy(packets(s, d).select("seq", "src", "us", "length"), ["src"], 3000, "bytes").groupBy("src", "chunk").agg(F.count("*").alias("n")),
    f"{_recursive}, n as (select src, length, row_number() over (partition by src order by seq) as i from packets), r as (select src, i, length as used, cast(0 as bigint) as chunk from n where i = 1 union all select n.src, n.i, case when r.used > 0 and r.used + n.length > 3000 then n.length else r.used + n.length end, case when r.used > 0 and r.used + n.length > 3000 then r.chunk + 1 else r.chunk end from r join n on n.src = r.src and n.i = r.i + 1) select src, chunk, count(*) as n from r group by all",
)
add("flow15_seek", lambda s, d: flows.seek(packets(s, d), 1705000000000000).select("seq", "us"), over_packets("select seq, us from packets where us >= 1705000000000000 order by us, seq limit 1"))
add("flow16_page", lambda s, d: flows.page(packets(s, d), 500, 40, ["seq"]).select("seq", "src"), over_packets("select seq, src from packets order by seq limit 40 offset 500"))


def _steps(s, d):
    return packets(s, d).selectExpr("seq", "concat(src, '-', cast(k % 10 as string)) as flow_id", "kind in ('click', 'signup', 'error') as from_client", "kind = 'error' or kind = 'purchase' as syn", "kind = 'purchase' as ack", "case when kind in ('click', 'view', 'signup') then 10 else 0 end as payload_len", "us div 1000 as ms", "concat('svc', cast(k % 10 as string)) as server", "src as client")


add(
    "flow17_service_calls",
    lambda s, d: flows.service_calls(_steps(s, d)).select("client", "server", "calls", F.round("median_ms", 3).alias("median_ms"), "max_ms"),
    over_packets("select client, server, count(*) as calls, round(median(lat), 3) as median_ms, max(lat) as max_ms from (select *, ms - max(case when q and fresh then ms end) over (partition by client, server order by ms, seq) as lat from (select seq, src as client, concat('svc', k % 10) as server, us // 1000 as ms, kind <> 'view' as q, coalesce(lag(kind <> 'view') over (partition by src, k % 10 order by us // 1000, seq) <> (kind <> 'view'), true) as fresh from packets where kind in ('click', 'view', 'signup'))) where not q and fresh and lat is not null group by all"),
)


def _spans(s, d):
    return packets(s, d).selectExpr("cast(seq / 20 as bigint) as trace_id", "seq % 20 as span_id", "case when seq % 20 > 0 then cast((seq % 20 - 1) / 2 as bigint) + case when seq % 20 = 9 then 100 else 0 end end as parent_id", "us div 1000 as start_ms", "case when kind <> 'error' then us div 1000 + length end as end_ms")


add(
    "flow18_traces",
    lambda s, d: flows.traces(_spans(s, d)).select("trace_id", "span_id", "offset_ms", "duration_ms", "total_ms", "depth"),
    over_packets("select trace_id, i as span_id, start_ms - min(start_ms) over w as offset_ms, end_ms - start_ms as duration_ms, max(coalesce(end_ms, start_ms)) over w - min(start_ms) over w as total_ms, cast(case when i = 0 then 0 when i = 9 then 0 when i in (19) then 1 else floor(log2(i + 1)) end as bigint) as depth from (select seq // 20 as trace_id, seq % 20 as i, us // 1000 as start_ms, case when kind <> 'error' then us // 1000 + length end as end_ms from packets) window w as (partition by trace_id)"),
)
add(
    "flow19_trace_headers",
    lambda s, d: packets(s, d).select("seq", F.concat(F.lit("GET / HTTP/1.1\ntraceparent: "), F.when(F.col("k") == 3, "ff").otherwise("00"), F.lit("-"), F.when(F.col("k") == 4, F.lit("0" * 32)).otherwise(F.md5("summary")), F.lit("-00f067aa0ba902b7-01\n")).alias("text"), "summary").select("seq", flows.trace_headers(F.col("text"))["trace_id"].alias("trace_id")),
    over_packets("select seq, case when k not in (3, 4) then md5(summary) end as trace_id from packets"),
)
add(
    "flow20_magic_census",
    lambda s, d: flows.magic_census(packets(s, d).select("seq", F.unhex(F.concat(F.hex("summary"), F.when(F.col("k") % 5 == 0, "FFD8FFE0").when(F.col("k") % 5 == 1, "504B0304").otherwise("00"))).alias("data"))).select("seq", "file_kind", "file_offset"),
    over_packets("select seq, case k % 5 when 0 then 'jpeg' else 'zip' end as file_kind, length(summary) as file_offset from packets where k % 5 < 2"),
)


def _byte_segments(s, d):
    """Segments whose payloads begin or end with parts of file marks, so that marks stand inside packets and across their borders."""
    data = F.unhex(F.concat(F.when(F.col("seq") % 3 == 0, "FF").when(F.col("seq") % 3 == 1, "D9").otherwise(""), F.hex("summary"), F.when(F.col("seq") % 4 == 1, "FFD8").when(F.col("seq") % 4 == 3, "FFD8FFE0").otherwise("")))
    return flows.stream_segments(_segments(s, d).where("payload_len > 0").withColumn("data", data), ["src", "port"])


_BYTES = (
    SEGMENTS,
    "last as (select src, port, tcp_seq, arg_max(concat(case seq % 3 when 0 then 'FF' when 1 then 'D9' else '' end, hex(summary), case seq % 4 when 1 then 'FFD8' when 3 then 'FFD8FFE0' else '' end), seq) as h from segments where payload_len > 0 group by all)",
    "streams as (select src, port, string_agg(h, '' order by tcp_seq) as h from last group by all)",
)
add(
    "flow07_stream_segments",
    lambda s, d: _byte_segments(s, d).select("src", "port", "tcp_seq", "offset", F.octet_length("data").alias("size")),
    over_packets("select src, port, tcp_seq, cast(sum(length(h) // 2) over (partition by src, port order by tcp_seq) - length(h) // 2 as bigint) as offset, cast(length(h) // 2 as int) as size from last", *_BYTES),
)
add(
    "flow20_carved_files",
    lambda s, d: flows.carve(_byte_segments(s, d), ["src", "port"]).select("src", "port", "file_kind", "file_offset", "file_size"),
    "with recursive " + over_packets(
        "select src, port, 'jpeg' as file_kind, place as file_offset, size as file_size from files where taken",
        *_BYTES,
        "found as (select src, port, length(h) // 2 as n, list_filter(range(0, length(h) // 2), lambda i: h[2 * i + 1:2 * i + 4] = 'FFD9') as ends, unnest(list_filter(range(0, length(h) // 2), lambda i: h[2 * i + 1:2 * i + 6] = 'FFD8FF')) as place from streams)",
        "starts as (select src, port, place, coalesce(list_min(list_filter(ends, lambda e: e >= place + 3)) + 2, n) - place as size, row_number() over (partition by src, port order by place) as i from found)",
        "files as (select src, port, place, size, i, place + size as free, true as taken from starts where i = 1 union all "
        "select n.src, n.port, n.place, n.size, n.i, case when n.place >= f.free then n.place + n.size else f.free end, n.place >= f.free from files f join starts n on n.src = f.src and n.port = f.port and n.i = f.i + 1)",
    )[5:],
)
