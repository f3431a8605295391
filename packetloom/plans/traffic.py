"""Queries over projections (PRJ-*) and statistics (STAT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import projections as prj
from ..operators import stats
from ..sources.adapters import over_packets, packets, table
from .book import Book

BOOK = Book()
add = BOOK.add


def frames(s, d):
    """IPv4 packets as Ethernet frames; every third has a VLAN tag, UDP services a UDP header, all a short HTTP or DNS payload."""
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    p = packets(s, d).where("dst not like '%:%'")
    udp = F.col("protocol").isin("DNS", "NTP")
    tag = F.when(F.col("seq") % 3 == 0, "81000005").otherwise("")
    l4 = F.when(udp, F.concat(hexed(F.col("sport"), 4), hexed(F.col("dport"), 4), F.lit("00080000"))).otherwise(F.concat(hexed(F.col("sport"), 4), hexed(F.col("dport"), 4), F.lit("000000000000000050"), hexed(F.col("flags"), 2), F.lit("FFFF00000000")))
    name = F.concat(F.lit("a"), F.col("k").cast("string"))
    dns = F.concat(F.lit("000001000001000000000000"), hexed(F.length(name), 2), F.hex(name), F.lit("07"), F.hex(F.lit("example")), F.lit("03"), F.hex(F.lit("com")), F.lit("0000010001"))
    http = F.hex(F.concat(F.lit("GET /item/"), F.col("k").cast("string"), F.lit(" HTTP/1.1\r\nHost: h"), (F.col("k") % 7).cast("string"), F.lit(".example.com\r\n\r\n")))
    raw = F.concat(F.lit("0" * 24), tag, F.lit("0800450000280000000040"), F.when(udp, "11").otherwise("06"), F.lit("0000"), hexed(scalars.ip_number(F.col("src")), 8), hexed(scalars.ip_number(F.col("dst")), 8), l4, F.when(udp, dns).otherwise(http))
    return p.select("seq", "protocol", "k", F.unhex(raw).alias("data"))


add(
    "prj01_frame_headers",
    lambda s, d: prj.frame_headers(frames(s, d)).select("seq", "l3", "src", "dst", "sport", "dport", "tcp_flags", F.length("payload").alias("payload_len")),
    over_packets("select seq, 'IPv4' as l3, src, dst, sport, dport, case when protocol not in ('DNS', 'NTP') then flags end as tcp_flags, cast(case when protocol in ('DNS', 'NTP') then 30 + length(concat('a', k)) else 45 + length(cast(k as string)) end as int) as payload_len from packets where dst not like '%:%'"),
)
add(
    "prj02_dns_question",
    lambda s, d: prj.frame_headers(frames(s, d)).where("dport = 53").select("seq", prj.dns_question(F.col("payload")).alias("name")),
    over_packets("select seq, concat('a', k, '.example.com') as name from packets where dst not like '%:%' and dport = 53"),
)
add(
    "prj03_http_fields",
    lambda s, d: prj.frame_headers(frames(s, d)).where("dport in (80, 8080)").select("seq", *(c.alias(n) for n, c in prj.http_fields(F.col("payload")).items())),
    over_packets("select seq, 'GET' as method, concat('/item/', k) as uri, concat('h', k % 7, '.example.com') as host, cast(null as int) as status from packets where dst not like '%:%' and dport in (80, 8080)"),
)
add(
    "prj04_summary_domain",
    lambda s, d: packets(s, d).where("kind = 'view'").groupBy(prj.summary_domain().alias("domain")).agg(F.count("*").alias("n")),
    over_packets("select concat('a', k, '.example', k % 5, '.com') as domain, count(*) as n from packets where kind = 'view' group by k"),
)
add(
    "prj05_endpoint",
    lambda s, d: packets(s, d).select("seq", prj.endpoint(F.col("src"), F.col("sport"), F.when(F.col("src") == "10.1.0.5", "printer")).alias("a"), prj.endpoint(F.col("dst"), F.when(F.col("k") != 95, F.col("dport"))).alias("b")),
    over_packets("select seq, concat(case when src = '10.1.0.5' then 'printer' else src end, ':', sport) as a, case when k = 95 then '[2001:db8::95]' else concat(case when dst like '%:%' then concat('[', dst, ']') else dst end, ':', dport) end as b from packets"),
)
SEV = "case when regexp_matches(summary, '(?i)(^|[^a-z0-9])RST([^a-z0-9]|$)') then 'Error' when summary like '%[TCP Retransmission]%' or summary like '%NXDOMAIN%' then 'Warning' when regexp_matches(summary, '(?i)(^|[^a-z0-9])(SYN|FIN)([^a-z0-9]|$)') then 'Note' else 'Chat' end"
add(
    "prj06_expert_severity",
    lambda s, d: packets(s, d).groupBy(prj.expert_severity().alias("severity"), "kind").agg(F.count("*").alias("n")),
    over_packets(f"select {SEV} as severity, kind, count(*) as n from packets group by 1, 2"),
)
add(
    "prj07_diagnostics",
    lambda s, d: prj.diagnostics(packets(s, d)).groupBy("severity_level", "diag_group", "title").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")),
    over_packets("select severity_level, diag_group, title, count(*) as n, cast(sum(seq) as bigint) as seq_sum from (select seq, 'Warning' as severity_level, 'Sequence' as diag_group, 'TCP Packet Retransmission' as title from packets where summary like '%[TCP Retransmission]%' union all select seq, 'Error', 'ProtocolViolation', 'Abrupt TCP Connection Reset (RST)' from packets where kind = 'error' union all select seq, 'Warning', 'General', 'DNS Resolution Error Response' from packets where summary like '%NXDOMAIN%') group by all"),
)
add(
    "prj08_severity_score",
    lambda s, d: packets(s, d).groupBy("src").agg(F.sum(prj.severity_score(prj.expert_severity())).alias("score")),
    over_packets(f"select src, cast(sum(case {SEV} when 'Error' then 9 when 'Warning' then 6 when 'Note' then 3 else 0 end) as bigint) as score from packets group by src"),
)
add(
    "prj09_payload_class",
    lambda s, d: table(s, d, "documents").select("doc_id", prj.payload_class(F.encode("text", "UTF-8")).alias("payload_class")),
    "with b as (select doc_id, text, hex(encode(text)) as h from documents), v as (select doc_id, substring(h, 2 * i + 1, 2) as v from (select doc_id, h, unnest(range(length(h) // 2)) as i from b)), n as (select doc_id, v, count(*) as n, sum(count(*)) over (partition by doc_id) as t from v group by 1, 2), "
    "e as (select doc_id, -sum((n / t) * log2(n / t)) as e, sum(case when (v between '21' and '7E') or v in ('20', '09', '0A', '0D', '0C') then n else 0 end) / any_value(t) as p from n group by doc_id) "
    "select b.doc_id, case when length(text) = 0 then 'empty' when text like 'MZ%' and length(h) >= 8 then 'executable' when text like 'data: %' or text like '%event: %' then 'sse' when (trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) like '{%' and trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) like '%}') or (trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) like '[%' and trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) like '%]') then 'json' when e > 7.4 then 'encrypted' when text like 'PK%' then 'compressed' when p > 0.85 then 'text' else 'binary' end as payload_class from b left join e on e.doc_id = b.doc_id",
)
add(
    "prj10_payload_findings",
    lambda s, d: prj.payload_findings(packets(s, d).select("seq", F.encode("summary", "UTF-8").alias("data"))).groupBy("finding_severity", "category", "title").agg(F.count("*").alias("n")),
    over_packets("select 'medium' as finding_severity, 'credentials' as category, 'Unencrypted Credential / Token In Payload' as title, count(*) as n from packets where kind = 'signup'"),
)
add(
    "prj11_printable_strings",
    lambda s, d: table(s, d, "documents").select("doc_id", prj.printable_strings(F.col("text"), 12).alias("strings")),
    "select doc_id, regexp_extract_all(text, '([\\x20-\\x7e]{12,})', 1) as strings from documents",
)
add(
    "prj12_protocol_guess",
    lambda s, d: packets(s, d).groupBy("protocol", prj.guess_protocol(F.col("dport"), F.encode("summary", "UTF-8")).alias("guess")).agg(F.count("*").alias("n")),
    over_packets("select protocol, case when kind in ('click', 'signup', 'purchase') then 'HTTP' when dport = 80 then 'HTTP' when dport = 443 then 'TLS' when dport = 53 then 'DNS' when dport = 22 then 'SSH' when dport = 445 then 'SMB' when dport = 25 then 'SMTP' else 'Unknown' end as guess, count(*) as n from (select * replace (case when kind = 'signup' then 'other' else kind end as kind) from packets) group by 1, 2"),
)
add(
    "prj13_http_meaning",
    lambda s, d: packets(s, d).groupBy(prj.http_meaning(F.col("summary")).alias("meaning")).agg(F.count("*").alias("n")),
    over_packets("select case kind when 'click' then concat('Client reads /item/', k) when 'signup' then 'Client sends data to /signup' when 'purchase' then concat('Request ', case when k < 25 then 'succeeded' when k < 50 then 'was redirected' when k < 75 then 'was refused' else 'failed at the server' end, ' (', 200 + k * 4, ')') end as meaning, count(*) as n from packets group by 1"),
)
add(
    "prj14_row_diff",
    lambda s, d: prj.row_diff(packets(s, d).where("seq = 7"), packets(s, d).where("seq = 12"), ["src", "dst", "protocol", "length", "hour"]),
    over_packets("select field, left_value, right_value, left_value is not distinct from right_value as same from (select unnest(['src', 'dst', 'protocol', 'length', 'hour']) as field, unnest([a.src, a.dst, a.protocol, cast(a.length as string), cast(a.hour as string)]) as left_value, unnest([b.src, b.dst, b.protocol, cast(b.length as string), cast(b.hour as string)]) as right_value from packets a, packets b where a.seq = 7 and b.seq = 12)"),
)


def _techniques(s, d):
    ids, phases = prj.techniques(F.col("protocol"), F.col("summary"), F.col("dport"), F.col("length") > 1500)
    return packets(s, d).groupBy(F.array_join(ids, ",").alias("ids"), F.array_join(phases, ",").alias("phases")).agg(F.count("*").alias("n"))


add(
    "prj15_techniques",
    _techniques,
    over_packets("select case when dport = 445 then 'T1021.002,T1046' when dport = 3389 then 'T1021.001,T1046' when dport = 22 then 'T1021.004' when dport = 53 then case when length > 1500 then 'T1071.004' else 'T1590' end when dport in (80, 443, 8080) then 'T1071' else 'T1046' end as ids, case when dport = 445 then 'Weaponization,Delivery,Actions on Objective' when dport = 3389 then 'Exploitation,Command and Control' when dport = 22 then 'Exploitation' when dport = 53 then case when length > 1500 then 'Command and Control' else 'Reconnaissance' end when dport in (80, 443, 8080) then 'Command and Control' else 'Reconnaissance' end as phases, count(*) as n from packets group by 1, 2"),
)
add(
    "prj16_first_technique",
    lambda s, d: packets(s, d).groupBy(*(c.alias(n) for n, c in prj.first_technique(F.col("protocol"), F.col("summary")).items())).agg(F.count("*").alias("n")),
    over_packets("select case when protocol = 'DNS' and kind = 'view' then 'Reconnaissance' when protocol in ('SSH', 'RDP') then 'Lateral Movement' when protocol in ('HTTP', 'TLS') then 'Command and Control' end as tactic, case when protocol = 'DNS' and kind = 'view' then 'T1590' when protocol in ('SSH', 'RDP') then 'T1021' when protocol in ('HTTP', 'TLS') then 'T1071' end as technique, case when protocol = 'DNS' and kind = 'view' then 'Recon' when protocol in ('SSH', 'RDP') then 'Exploitation' when protocol in ('HTTP', 'TLS') then 'Command and Control' end as phase, count(*) as n from packets group by all"),
)
add(
    "prj17_siem_lines",
    lambda s, d: packets(s, d).select(
        "seq",
        prj.syslog_line(F.col("sensor"), F.col("protocol"), prj.severity_score(prj.expert_severity()), F.col("summary"), F.col("us").cast("string")).alias("syslog"),
        prj.cef_line(F.concat(F.col("kind"), F.lit("|x")), prj.severity_score(prj.expert_severity()), {"src": F.col("src"), "dst": F.when(F.col("k") != 95, F.col("dst")), "dpt": F.col("dport")}).alias("cef"),
        prj.leef_line(F.col("kind"), {"src": F.col("src"), "proto": F.col("protocol")}).alias("leef"),
        prj.ocsf_activity({"src": F.col("src"), "port": F.when(F.col("k") != 95, F.col("dport"))}).alias("ocsf"),
    ),
    over_packets(f"select seq, concat('<', 128 + sc, '>1 ', us, ' ', sensor, ' ', protocol, ' - - - ', summary) as syslog, concat('CEF:0|packetloom|engine|1|100|', kind, '\\|x|', sc, '|src=', src, case when k <> 95 then concat(' dst=', dst) else '' end, ' dpt=', dport) as cef, concat('LEEF:2.0|packetloom|engine|1|', kind, '|src=', src, chr(9), 'proto=', protocol) as leef, concat('{{\"class_uid\":4001,\"category_uid\":4,\"src\":\"', src, '\"', case when k <> 95 then concat(',\"port\":', dport) else '' end, '}}') as ocsf from (select *, case {SEV} when 'Error' then 9 when 'Warning' then 6 when 'Note' then 3 else 0 end as sc from packets)").replace("{{", "{").replace("}}", "}"),
)
add(
    "prj18_ocsf_views",
    lambda s, d: packets(s, d).select("seq", F.to_json(F.struct(F.lit(2001).alias("class_uid"), F.col("kind").alias("title"), F.struct(F.col("src").alias("ip")).alias("actor"))).alias("finding")),
    over_packets("select seq, concat('{\"class_uid\":2001,\"title\":\"', kind, '\",\"actor\":{\"ip\":\"', src, '\"}}') as finding from packets"),
)
add(
    "prj19_stix",
    lambda s, d: packets(s, d).where("dst not like '%:%'").select("dst").distinct().select("dst", prj.stix_indicator(F.lit("ip"), F.col("dst"), F.lit("seen")).alias("stix")),
    over_packets("select distinct dst, concat('{\"type\":\"indicator\",\"spec_version\":\"2.1\",\"id\":\"indicator--', substr(sha256(dst), 1, 32), '\",\"pattern\":\"[ipv4-addr:value = ''', dst, ''']\",\"description\":\"seen\"}') as stix from packets where dst not like '%:%'"),
)
add(
    "prj20_explanation",
    lambda s, d: packets(s, d).select("seq", prj.explanation(F.col("protocol"), F.col("src"), F.col("dst"), F.col("dport")).alias("why")),
    over_packets("select seq, case when protocol = 'SMB' then concat(src, ' reached a file share on ', dst, '. 1. Check the account. 2. Check shares.') when protocol = 'RDP' then concat(src, ' opened a desktop session on ', dst, '. 1. Confirm with the user.') when protocol = 'DNS' then concat(src, ' looked up names at ', dst, '. 1. Check the domain.') when protocol in ('HTTP', 'TLS') then concat(src, ' talked to ', dst, ' on port ', dport, '. 1. Check the host.') else concat(src, ' talked to ', dst, '. 1. Review.') end as why from packets"),
)
add(
    "prj21_protocol_risk",
    lambda s, d: prj.with_protocol_risk(packets(s, d)).groupBy("protocol", "risk").agg(F.count("*").alias("n")),
    over_packets("select protocol, case protocol when 'HTTP' then 'medium' when 'SMB' then 'medium' when 'RDP' then 'high' when 'MODBUS' then 'high' when 'DNS' then 'low' when 'NTP' then 'low' end as risk, count(*) as n from packets group by 1, 2"),
)

# Statistics
add("stat01_totals", lambda s, d: stats.totals(packets(s, d)), over_packets("select count(*) as packets, cast(sum(length) as bigint) as bytes from packets"))
add("stat02_by_protocol", lambda s, d: stats.totals(packets(s, d), ["protocol"]), over_packets("select protocol, count(*) as packets, cast(sum(length) as bigint) as bytes from packets group by protocol"))
add(
    "stat03_length_histogram",
    lambda s, d: stats.length_histogram(packets(s, d)),
    over_packets("select case when length <= 79 then '0-79' when length <= 639 then '80-639' when length <= 1279 then '640-1279' when length <= 1500 then '1280-1500' else '>1500' end as bin, count(*) as packets from packets group by 1"),
)
add(
    "stat04_protocol_hierarchy",
    lambda s, d: stats.protocol_hierarchy(packets(s, d)),
    over_packets("select l3, l4, app, count(*) as packets, cast(sum(length) as bigint) as bytes, cast(grouping_id(l3, l4, app) as bigint) as level from (select case when dst like '%:%' then 'IPv6' else 'IPv4' end as l3, case when protocol in ('DNS', 'NTP') then 'udp' else 'tcp' end as l4, protocol as app, length from packets) group by rollup (l3, l4, app)"),
)
for _key, _name in (("src", "sent"), ("dst", "received")):
    add(f"stat05_top_{_name}", lambda s, d, k=_key: stats.top(packets(s, d), k), over_packets(f"select {_key}, count(*) as packets, cast(sum(length) as bigint) as bytes from packets group by 1 order by bytes desc, 1 limit 10"))
add(
    "stat06_top_domains",
    lambda s, d: stats.top(packets(s, d).where("kind = 'view'").withColumn("domain", prj.summary_domain()), "domain"),
    over_packets("select domain, count(*) as packets, cast(sum(length) as bigint) as bytes from (select concat('a', k, '.example', k % 5, '.com') as domain, length from packets where kind = 'view') group by 1 order by bytes desc, 1 limit 10"),
)
add(
    "stat07_bandwidth",
    lambda s, d: stats.rate_with_mean(packets(s, d), 3600).withColumn("mean_bytes", F.round("mean_bytes", 6)),
    over_packets("select bucket, bytes, round(avg(bytes) over (order by bucket rows between 59 preceding and current row), 6) as mean_bytes from (select us // 3600000000 as bucket, cast(sum(length) as bigint) as bytes from packets group by 1)"),
)
add(
    "stat08_tiles",
    lambda s, d: stats.tiles(packets(s, d), 21600).withColumn("error_rate", F.round("error_rate", 6)),
    over_packets("select us // 21600000000 as bucket, cast(sum(length) as bigint) as bytes, count(*) as packets, round(avg(case when kind = 'error' then 1.0 else 0.0 end), 6) as error_rate, count(distinct src) as hosts from packets group by 1"),
)
add(
    "stat09_busiest",
    lambda s, d: stats.busiest(packets(s, d), 3600),
    over_packets("select bucket, bucket_bytes, hour, hour_bytes from (select us // 3600000000 as bucket, cast(sum(length) as bigint) as bucket_bytes from packets group by 1 order by 2 desc, 1 limit 1), (select hour, cast(sum(length) as bigint) as hour_bytes from packets group by 1 order by 2 desc, 1 limit 1)"),
)
add(
    "stat10_trend",
    lambda s, d: stats.trend(packets(s, d), 86400, 5).select(F.round("slope", 4).alias("slope"), F.round("projected", 3).alias("projected"), "direction"),
    over_packets("select round(slope, 4) as slope, round(base + slope * (last + 5), 3) as projected, case when slope / mean > 0.01 then 'rising' when slope / mean < -0.01 then 'falling' else 'steady' end as direction from (select regr_slope(y, x) as slope, regr_intercept(y, x) as base, max(x) as last, avg(y) as mean from (select cast(us // 86400000000 as double) as x, cast(sum(length) as double) as y from packets group by 1))"),
)
add("stat11_capture_info", lambda s, d: stats.capture_info(packets(s, d)), over_packets("select count(*) as packets, cast(sum(length) as bigint) as bytes, arg_min(us, seq) as first_us, arg_max(us, seq) as last_us, arg_max(us, seq) - arg_min(us, seq) as duration_us from packets"))
add(
    "stat12_distribution_entropy",
    lambda s, d: stats.token_entropy(packets(s, d), "dst").select(F.round("entropy", 6).alias("entropy")),
    over_packets("select round(-sum((n / t) * log2(n / t)), 6) as entropy from (select count(*) as n, sum(count(*)) over () as t from packets group by dst)"),
)
add(
    "stat13_iqr_outliers",
    lambda s, d: stats.quartile_outliers(packets(s, d), "src", "length").groupBy("src").agg(F.count("*").alias("n"), F.max("length").alias("top")),
    over_packets("select p.src, count(*) as n, max(length) as top from packets p join (select src, l[len(l) // 4 + 1] as q1, l[len(l) * 3 // 4 + 1] as q3 from (select src, list(length order by length) as l from packets group by src) where len(l) >= 4) q on q.src = p.src where length < q1 - 1.5 * (q3 - q1) or length > q3 + 1.5 * (q3 - q1) group by p.src"),
)
add(
    "stat14_summary_stats",
    lambda s, d: stats.summary_stats(packets(s, d), "length", ["protocol"]).withColumn("avg", F.round("avg", 6)),
    over_packets("select protocol, l[1] as min, l[len(l)] as max, round(a, 6) as avg, l[len(l) // 2 + 1] as median, l[least(cast(ceil(len(l) * 0.95) as bigint), len(l) - 1) + 1] as p95 from (select protocol, list(length order by length) as l, avg(length) as a from packets group by protocol)"),
)
add(
    "stat15_nearest_rank",
    lambda s, d: stats.nearest_rank(packets(s, d), "length", ["src"]),
    over_packets("select src, l[cast(round((len(l) - 1) * 0.5::double) as bigint) + 1] as p50, l[cast(round((len(l) - 1) * 0.95::double) as bigint) + 1] as p95, l[cast(round((len(l) - 1) * 0.99::double) as bigint) + 1] as p99 from (select src, list(length order by length) as l from packets group by src)"),
)
add(
    "stat16_site_errors",
    lambda s, d: stats.site_errors(packets(s, d).withColumn("code", F.when(F.col("kind") == "purchase", 200 + F.col("k") * 4)), "dst", "code"),
    over_packets("select dst, cast(200 + k * 4 as int) as code, count(*) as n, case 200 + k * 4 when 400 then 'Bad Request' when 404 then 'Not Found' when 408 then 'Request Timeout' when 500 then 'Internal Server Error' when 504 then 'Gateway Timeout' end as reason from packets where kind = 'purchase' and k * 4 between 200 and 399 group by dst, k"),
)
add(
    "stat17_exposure",
    lambda s, d: stats.exposure_score(packets(s, d), "dst").withColumn("score", F.round("score", 6)),
    over_packets("select dst, round(least(100.0::double, 30.0::double * max(case when protocol = 'HTTP' then 1 else 0 end) + 40.0 * max(case when kind = 'signup' then 1 else 0 end) + 20.0 * avg(case when kind = 'error' then 1.0::double else 0.0 end) + 10.0 * max(case when dport = 123 then 1 else 0 end)), 6) as score from packets group by dst"),
)


def _owners(s):
    return s.createDataFrame([("example1.com", "one"), ("example2.com", "two"), ("a7.example2.com", "seven"), ("example.org", "org")], "suffix string, owner string")


add(
    "stat18_services",
    lambda s, d: stats.services(packets(s, d).where("kind = 'view'").withColumn("host", prj.summary_domain()), "host", _owners(s)),
    over_packets("select case when k = 7 then 'seven' when k % 5 = 1 then 'one' when k % 5 = 2 then 'two' else 'other' end as owner, count(*) as requests, count(distinct k) as hosts from packets where kind = 'view' group by 1"),
)
add(
    "stat19_host_marks",
    lambda s, d: stats.classify_hosts(table(s, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).withColumn("name", F.col("host")), "host", "name"),
    "select host, ['tracker'] as marks from (select distinct regexp_extract(url, '://([^/?#]*)', 1) as host from pages) where regexp_matches(host, '(?i)(^|[.])(track|ads?|metrics|analytics)[.-]')",
)
add(
    "stat20_voip",
    lambda s, d: stats.voip_calls(packets(s, d).withColumn("summary", F.concat(F.lit("RTP SSRC=0x"), F.hex(F.col("k") % 16), F.lit(" jitter="), (F.col("length") % 50).cast("string")))).withColumns({"jitter_ms": F.round("jitter_ms", 6), "mos": F.round("mos", 6)}),
    over_packets("select upper(to_hex(k % 16)) as ssrc, count(*) as packets, round(avg(length % 50), 6) as jitter_ms, round(greatest(1.0::double, 4.4::double - avg(length % 50) / 50), 6) as mos from packets group by 1"),
)
add(
    "stat21_encrypted_share",
    lambda s, d: stats.encrypted_share(packets(s, d)),
    over_packets("select tls, http, cast(round(100 * tls / (tls + http)) as bigint) as encrypted_pct from (select count(*) filter (protocol = 'TLS') as tls, count(*) filter (protocol = 'HTTP') as http from packets)"),
)
