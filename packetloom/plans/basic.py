"""Queries over scalar functions (FN-*) and predicates (FLT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters
from ..sources.adapters import alerts, packets, table
from ..sources.adapters import ALERTS, over_packets
from .book import Book

BOOK = Book()
add = BOOK.add


def _where(name: str, condition, sql: str) -> None:
    """A query that counts what a predicate keeps, by protocol, with the sum of their numbers."""
    add(
        name,
        lambda s, d: packets(s, d).where(condition()).groupBy("protocol").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")),
        over_packets(f"select protocol, count(*) as n, cast(sum(seq) as bigint) as seq_sum from packets where {sql} group by protocol"),
    )


# Scalar functions
add(
    "fn01_byte_entropy",
    lambda s, d: table(s, d, "documents").select("doc_id", F.round(scalars.byte_entropy(F.encode("text", "UTF-8")), 6).alias("entropy")),
    "with b as (select doc_id, hex(encode(text)) as h from documents), c as (select doc_id, substring(h, 2 * i + 1, 2) as v from (select doc_id, h, unnest(range(length(h) // 2)) as i from b)), "
    "n as (select doc_id, v, count(*) as n, sum(count(*)) over (partition by doc_id) as t from c group by doc_id, v) select d.doc_id, round(coalesce(-sum((n / t) * log2(n / t)), 0.0), 6) as entropy from documents d left join n on n.doc_id = d.doc_id group by d.doc_id",
)
add(
    "fn02_char_entropy",
    lambda s, d: packets(s, d).groupBy("summary").agg(F.count("*").alias("n")).select("summary", "n", F.round(scalars.char_entropy(F.col("summary")), 6).alias("entropy")),
    over_packets("select p.summary, p.n, round(e.h, 6) as entropy from (select summary, count(*) as n from packets group by summary) p join (select summary, -sum((n / t) * log2(n / t)) as h from (select summary, c, count(*) as n, sum(count(*)) over (partition by summary) as t from (select summary, unnest(string_split(summary, '')) as c from (select distinct summary from packets)) group by summary, c) group by summary) e on e.summary = p.summary"),
)
CARD = "lpad(cast(o_orderkey * 7919 + o_custkey as string), 16, '4')"
add(
    "fn03_luhn",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(CARD).alias("card")).select("o_orderkey", "card", scalars.luhn_valid(F.col("card")).alias("valid")),
    f"select o_orderkey, card, sum(case when i % 2 = 1 then v when v * 2 > 9 then v * 2 - 9 else v * 2 end) % 10 = 0 as valid from (select o_orderkey, card, i, cast(substr(card, 17 - i, 1) as int) as v from (select o_orderkey, {CARD} as card from orders), range(1, 17) r(i)) group by o_orderkey, card",
)
TCKN = "cast(10000000000 + o_orderkey * 1234567 % 89999999999 as string)"
add(
    "fn04_national_id",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(TCKN).alias("id")).select("o_orderkey", scalars.national_id_valid(F.col("id")).alias("valid")),
    f"select o_orderkey, (((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 = d[10] and (d[1] + d[3] + d[5] + d[7] + d[9] + d[2] + d[4] + d[6] + d[8] + d[10]) % 10 = d[11] as valid from (select o_orderkey, list_transform(string_split({TCKN}, ''), lambda x: cast(x as int)) as d from orders)",
)
add(
    "fn05_address_scope",
    lambda s, d: packets(s, d).select(F.explode(F.array("src", "dst")).alias("ip")).groupBy("ip").agg(F.count("*").alias("n")).select("ip", "n", scalars.address_scope(F.col("ip")).alias("scope"), scalars.ip_sort_key(F.col("ip")).alias("sort_key")),
    over_packets("select ip, count(*) as n, case when ip like '10.%' or ip like '192.168.%' then 'private' else 'public' end as scope, case when ip like '%:%' then concat('620010db8', repeat('0', 20), lpad(split_part(ip, '::', 2), 4, '0')) else concat('4', lpad(upper(to_hex(cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint))), 8, '0')) end as sort_key from (select src as ip from packets union all select dst from packets) group by ip"),
)
add(
    "fn06_ip_number",
    lambda s, d: packets(s, d).groupBy("dst").agg(F.count("*").alias("n")).select("dst", "n", scalars.ip_number(F.col("dst")).alias("number"), scalars.in_network(F.col("dst"), "192.168.1.32/27").alias("inside")),
    over_packets("select dst, count(*) as n, case when dst not like '%:%' then cast(split_part(dst, '.', 1) as bigint) * 16777216 + cast(split_part(dst, '.', 2) as bigint) * 65536 + cast(split_part(dst, '.', 3) as bigint) * 256 + cast(split_part(dst, '.', 4) as bigint) end as number, coalesce(dst like '192.168.1.%' and try_cast(split_part(dst, '.', 4) as int) between 32 and 63, false) as inside from packets group by dst"),
)
add(
    "fn07_duration",
    lambda s, d: packets(s, d).select("seq", F.expr("concat(cast(k as string), case k % 4 when 0 then 's' when 1 then 'm' when 2 then 'h' else 'x' end)").alias("text")).select("seq", scalars.duration_seconds(F.col("text")).alias("seconds")),
    over_packets("select seq, cast(case k % 4 when 0 then k when 1 then k * 60 when 2 then k * 3600 else 30 end as bigint) as seconds from packets"),
)
add(
    "fn08_human_bytes",
    lambda s, d: packets(s, d).select("seq", scalars.human_bytes(F.col("length") * F.col("length")).alias("size"), scalars.human_bytes(F.col("length") - F.col("length") % 100, 1000).alias("size_1000")),
    over_packets("select seq, case when length * length < 1024 then concat(length * length, ' B') when length * length < 1048576 then printf('%.1f KB', length * length / 1024.0) when length * length < 1073741824 then printf('%.1f MB', length * length / 1048576.0) else printf('%.1f GB', length * length / 1073741824.0) end as size, case when length < 1000 then concat(length - length % 100, ' B') else printf('%.1f KB', (length - length % 100) / 1000.0) end as size_1000 from packets"),
)
_where("fn09_has_token", lambda: scalars.has_token(F.col("summary"), "rst") | scalars.has_token(F.col("summary"), "Item"), "regexp_matches(summary, '(?i)(^|[^a-z0-9])(rst|item)([^a-z0-9]|$)')")
add(
    "fn10_url_host",
    lambda s, d: table(s, d, "pages").select("page_id", scalars.host_of(F.col("url")).alias("host")),
    "select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host from pages",
)
add(
    "fn11_mac_oui",
    lambda s, d: table(s, d, "supplier").select("s_suppkey", F.unhex(F.lpad(F.hex(F.col("s_suppkey") * 99991 + 11259375), 12, "0")).alias("m")).select("s_suppkey", scalars.mac_text(F.col("m")).alias("mac"), scalars.mac_oui(scalars.mac_text(F.col("m"))).alias("oui")),
    "select s_suppkey, lower(regexp_replace(h, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) as mac, upper(regexp_replace(substr(h, 1, 6), '(..)(..)(..)', '\\1:\\2:\\3')) as oui from (select s_suppkey, lpad(to_hex(cast(s_suppkey * 99991 + 11259375 as bigint)), 12, '0') as h from supplier)",
)
add(
    "fn12_sampling",
    lambda s, d: scalars.sampled(packets(s, d), 10, "us, seq", "sensor").groupBy("sensor").agg(F.count("*").alias("kept"), F.sum(F.col("length") * F.col("sampling_ratio")).alias("estimated_bytes")),
    over_packets("select sensor, count(*) as kept, cast(sum(length) * 10 as bigint) as estimated_bytes from (select *, row_number() over (partition by sensor order by us, seq) as n from packets) where n % 10 = 1 group by sensor"),
)

# Predicates
_where(
    "flt01_boolean_algebra",
    lambda: filters.any_of(filters.all_of(filters.text_leaf("protocol", "eq", "http"), filters.frame_length("gt", 300)), ~filters.either_port("lt", 30000)),
    "(lower(protocol) = 'http' and length > 300) or not (sport < 30000 or dport < 30000)",
)
_where("flt02_ip_addr", lambda: filters.either_address("eq", "10.1.0.5") | filters.either_address("eq", "192.168.1.7"), "src in ('10.1.0.5', '192.168.1.7') or dst in ('10.1.0.5', '192.168.1.7')")
_where("flt02_ip_addr_ne", lambda: filters.either_address("ne", "10.1.0.5"), "src <> '10.1.0.5' and dst <> '10.1.0.5'")
_where("flt03_ip_src_dst", lambda: filters.one_address("src", "ne", "10.1.0.5") & filters.one_address("dst", "contains", "168.1.1") & ~filters.one_address("src", "gt", "1"), "src <> '10.1.0.5' and dst like '%168.1.1%'")
_where("flt04_port", lambda: filters.either_port("ge", 8080) & filters.either_port("ne", 443), "(sport >= 8080 or dport >= 8080) and sport <> 443 and dport <> 443")
_where("flt05_transport_port", lambda: filters.either_port("le", 500, "udp"), "(sport <= 500 or dport <= 500) and protocol in ('DNS', 'NTP')")
_where("flt06_frame_len", lambda: filters.frame_length("contains", 77) | filters.frame_length("ge", 1000), "cast(length as string) like '%77%' or length >= 1000")
_where("flt07_tcp_flags", lambda: filters.tcp_flag("syn", "eq", 1) & filters.tcp_flag("ack", "eq", 0), "(flags & 2) <> 0 and (flags & 16) = 0")
_where("flt08_text_leaf", lambda: filters.text_leaf("summary", "contains", "ITEM") & filters.text_leaf("protocol", "ne", "dns") & ~filters.text_leaf("summary", "gt", "a"), "lower(summary) like '%item%' and lower(protocol) <> 'dns'")
_where("flt09_http_fields", lambda: filters.text_leaf(F.nullif(F.regexp_extract("summary", "^(GET|POST) ", 1), F.lit("")), "eq", "get") & filters.text_leaf(F.regexp_extract("summary", "^[A-Z]+ (\\S+)", 1), "contains", "item/1"), "regexp_extract(summary, '^(GET|POST) ', 1) = 'GET' and regexp_extract(summary, '^[A-Z]+ (\\S+)', 1) like '%item/1%'")
_where("flt10_dns_name", lambda: filters.text_leaf(F.nullif(F.regexp_extract("summary", "^Query A (\\S+)", 1), F.lit("")), "contains", "example3"), "regexp_extract(summary, '^Query A (\\S+)', 1) like '%example3%'")
_where("flt12_info_mined", lambda: filters.compare(F.nullif(F.regexp_extract("summary", "^HTTP/1.1 ([0-9]+)", 1), F.lit("")).cast("int"), "ge", 400), "cast(nullif(regexp_extract(summary, '^HTTP/1.1 ([0-9]+)', 1), '') as int) >= 400")
_where("flt13_protocol", lambda: filters.protocol_is("ipv4") & filters.protocol_is("tcp") & ~filters.protocol_is("ssh") & ~filters.protocol_is("ai_traffic"), "src not like '%:%' and protocol in ('TCP', 'HTTP', 'TLS', 'SMB', 'RDP', 'MODBUS')")
NAMES = "names as (select concat('10.', cast(s_suppkey % 4 as string), '.0.', cast(s_suppkey % 250 as string)) as ip, min(lower(s_name)) as name from supplier group by 1)"


def _names(s, d):
    ip = F.expr("concat('10.', cast(s_suppkey % 4 as string), '.0.', cast(s_suppkey % 250 as string))")
    return table(s, d, "supplier").groupBy(ip.alias("ip")).agg(F.min(F.lower("s_name")).alias("name"))


add(
    "flt14_free_text",
    lambda s, d: filters.free_text(packets(s, d), _names(s, d), "0000001").groupBy("src", "protocol").agg(F.count("*").alias("n")),
    over_packets("select src, protocol, count(*) as n from packets p left join names a on a.ip = p.src left join names b on b.ip = p.dst where lower(summary) like '%0000001%' or lower(protocol) like '%0000001%' or src like '%0000001%' or dst like '%0000001%' or a.name like '%0000001%' or b.name like '%0000001%' group by src, protocol", NAMES),
)
TREE = {"op": "AND", "items": [{"field": "protocol", "cmp": "eq", "value": "HTTP"}, {"op": "NOT", "items": [{"field": "dport", "cmp": "gt", "value": 80}, {"field": "kind", "cmp": "eq", "value": "error"}]}, {"op": "OR", "items": []}]}
FIELDS = {"protocol": "protocol", "dport": "dport", "kind": "kind"}
_where("flt15_hunt_text", lambda: filters.hunt(TREE, FIELDS), "protocol = 'HTTP' and not (cast(dport as string) > '80' or kind = 'error')")
_where("flt15_hunt_typed", lambda: filters.hunt(TREE, FIELDS, typed=True), "protocol = 'HTTP' and not (dport > 80 or kind = 'error')")
add(
    "flt16_event_list",
    lambda s, d: filters.event_list(packets(s, d), sensor="sensor-1", kind="click", since=1704500000000000, until=1705500000000000).select("seq", "src", "us"),
    over_packets("select seq, src, us from packets where sensor = 'sensor-1' and kind = 'click' and us between 1704500000000000 and 1705500000000000"),
)
RULES = "rules as (select min(p_partkey) as rule_id, p_partkey % 5 <> 4 as enabled, case p_partkey % 3 when 0 then 'error' when 1 then 'click' end as kind, case when p_partkey % 2 = 0 then 'DNS' end as protocol, case when p_partkey % 7 = 0 then 80 end as dport from part group by all)"


def rules(s, d):
    """The different rules of the whole table, each under its first number."""
    every = table(s, d, "part").selectExpr("p_partkey as rule_id", "p_partkey % 5 <> 4 as enabled", "case p_partkey % 3 when 0 then 'error' when 1 then 'click' end as kind", "case when p_partkey % 2 = 0 then 'DNS' end as protocol", "case when p_partkey % 7 = 0 then 80 end as dport")
    return every.groupBy("enabled", "kind", "protocol", "dport").agg(F.min("rule_id").alias("rule_id"))


add(
    "flt17_rule_match",
    lambda s, d: filters.match_rules(packets(s, d), rules(s, d)).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")),
    over_packets("select rule_id, count(*) as n, cast(sum(seq) as bigint) as seq_sum from packets e join rules r on enabled and (r.kind is null or r.kind = e.kind) and (r.protocol is null or r.protocol = e.protocol) and (r.dport is null or r.dport = e.dport) group by rule_id", RULES),
)
for _name, _sql in (("off_hours", "hour < 6 or hour > 20"), ("unsigned_smb", "protocol = 'SMB' and lower(summary) not like '%signed%'"), ("odd_dns", "protocol = 'DNS' and (length(summary) > 60 or regexp_matches(summary, '(?i)(^|[^a-z0-9])txt([^a-z0-9]|$)'))"), ("subnet_hours", "src like '10.1.%' and hour between 8 and 18")):
    _where(f"flt19_preset_{_name}", filters.PRESETS[_name], _sql)
add(
    "flt19_preset_high_anomaly",
    lambda s, d: alerts(s, d).withColumn("score", F.col("score") % 100).where(filters.PRESETS["high_anomaly"]()).groupBy("severity").agg(F.count("*").alias("n")),
    f"with {ALERTS} select severity, count(*) as n from alerts where score % 100 > 75 group by severity",
)
add(
    "flt20_pivot",
    lambda s, d: filters.pivot_by(packets(s, d), "src", "10.2.0.14").select("seq", "us", "dst", "summary"),
    over_packets("select seq, us, dst, summary from packets where src = '10.2.0.14'"),
)
add(
    "flt21_time_in_range",
    lambda s, d: packets(s, d).withColumn("minute", F.col("hour") * 60 + F.expr("cast(us / 60000000 as bigint) % 60").cast("int")).where(filters.time_in_range(F.col("minute"), "22:30", "05:15")).groupBy("hour").agg(F.count("*").alias("n")),
    over_packets("select hour, count(*) as n from (select hour, hour * 60 + (us // 60000000) % 60 as m from packets) where m >= 1350 or m <= 315 group by hour"),
)
add(
    "flt22_whitelist",
    lambda s, d: filters.without_listed(filters.without_listed(packets(s, d), _names(s, d), "src", "ip"), rules(s, d).where("dport is not null"), "dport").groupBy("src").agg(F.count("*").alias("n")),
    over_packets("select src, count(*) as n from packets where src not in (select ip from names) and dport not in (select dport from rules where dport is not null) group by src", NAMES, RULES),
)
add(
    "flt23_suppressed_ip",
    lambda s, d: filters.without_listed(packets(s, d), _names(s, d).where("ip like '10.3.%'"), "src", "ip").groupBy("protocol").agg(F.count("*").alias("n")),
    over_packets("select protocol, count(*) as n from packets where src not in (select ip from names where ip like '10.3.%') group by protocol", NAMES),
)
_where("flt24_noise", lambda: ~filters.is_noise(), "not (dport in (67, 68, 123, 137, 138, 1900, 5353, 5355))")
add(
    "flt_top_talkers_error",
    lambda s, d: packets(s, d).where(filters.text_leaf("kind", "eq", "error")).groupBy("src").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "src").limit(10),
    over_packets("select src, count(*) as packets, cast(sum(length) as bigint) as bytes from packets where kind = 'error' group by src order by bytes desc, src limit 10"),
)
