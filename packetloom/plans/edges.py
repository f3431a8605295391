"""Queries over sources and sinks (SRC-*, SNK-*), streams (STR-*) and user hooks (UDF-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hooks, joins
from ..sources import captures, feeds
from ..sources.adapters import HEARTBEATS, heartbeats, over_packets, packets, table
from ..sources.scratch import new_folder
from ..streaming import queries as st
from .anomalies import _cooldown_sql, _host_sql, _recursive
from .book import Book
from .sessions import MESSAGES
from .traffic import frames

BOOK = Book()
add = BOOK.add


#: Packets of a sensor by number, so many at most in one capture.
PIECE = 500


def _captures(s, d):
    """The packets as capture files of a sensor and a range of numbers: pcap of both byte orders, with nanoseconds, and pcapng in turn."""
    little = lambda c, n: F.concat(*(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)))
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    sec, micro, size, word = F.floor(F.col("us") / 1_000_000), F.col("us") % 1_000_000, F.length("data").cast("long"), F.lit(0).cast("long")
    rest = F.pmod(-size, F.lit(4)).cast("int")
    block = 32 + size + rest
    record = (
        F.when(F.col("form") == 0, F.concat(*(little(v, 4) for v in (sec, micro, size, size)), F.hex("data")))
        .when(F.col("form") == 1, F.concat(*(big(v, 4) for v in (sec, micro, size, size)), F.hex("data")))
        .when(F.col("form") == 2, F.concat(*(little(v, 4) for v in (sec, micro * 1000, size, size)), F.hex("data")))
        .otherwise(F.concat(F.lit("06000000"), *(little(v, 4) for v in (block, word, F.shiftright("us", 32), F.col("us").bitwiseAND(0xFFFFFFFF), size, size)), F.hex("data"), F.expr("repeat('00', pmod(-length(data), 4))"), little(block, 4)))
    )
    header = (
        F.when(F.col("form") == 0, "D4C3B2A1020004000000000000000000FFFF000001000000")
        .when(F.col("form") == 1, "A1B2C3D40002000400000000000000000000FFFF00000001")
        .when(F.col("form") == 2, "4D3CB2A1020004000000000000000000FFFF000001000000")
        .otherwise("0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000" "010000001400000001000000FFFF000014000000")
    )
    rows = frames(s, d).join(packets(s, d).select("seq", "us", "sensor"), "seq").withColumn("piece", F.floor(F.col("seq") / PIECE))
    rows = rows.withColumn("form", (F.col("piece") + F.substring("sensor", 8, 1).cast("int")) % 4)
    body = rows.groupBy("sensor", "piece", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", record.alias("r")))), lambda x: x["r"]), "").alias("r"))
    return body.select(F.concat_ws("/", "sensor", "piece").alias("path"), F.unhex(F.concat(header, "r")).alias("content"))


# Heads of files of all formats and of one that is none, by number; the rest of each file is a capture.
HEADS = (
    ("pcap", ""), ("modified pcap", "34CDB2A1"), ("pcapng", "0A0D0D0A1C000000"), ("snoop", "736E6F6F700000000000000200000004"), ("netmon", "474D42550002"), ("sniffer", "74726E7366696C6500"),
    ("erf", "000000000000000002040040000000300000"), ("k12", "2B" + "2D" * 62 + "2B0D0A"), ("unknown", "504B0304" + "00" * 12),
)


def _census(s, d):
    """The captures behind such heads; the first kind stays as it is, all of its forms but pcapng being pcap."""
    number = (F.split("path", "/")[1].cast("long") + F.split(F.split("path", "/")[0], "-")[1].cast("long")) % len(HEADS)
    head = F.element_at(F.array(*(F.lit(h) for _, h in HEADS)), (number + 1).cast("int"))
    return _captures(s, d).select(captures.capture_format(F.concat(F.unhex(head), "content")).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


def _capture_frames(s, d):
    """The captures written as files, and read again in ranges so small that most files are cut."""
    path = new_folder(s, "captures")
    captures.write_files(_captures(s, d), path)
    return captures.read_captures(s, path, 16 << 10)


_KINDS = " ".join(f"when {i} then '{name}'" for i, (name, _) in enumerate(HEADS) if i)
add(
    "src01_capture_frames",
    lambda s, d: _capture_frames(s, d).groupBy("ts_sec", "ts_nanos").agg(F.count("*").alias("n"), F.sum("orig_len").alias("bytes"), F.sum(F.length("data")).alias("kept")),
    over_packets(
        "select us // 1000000 as ts_sec, cast(us % 1000000 * 1000 as int) as ts_nanos, count(*) as n, cast(sum(size) as bigint) as bytes, cast(sum(size) as bigint) as kept from frames group by all",
        # Ethernet, tag, network and transport headers, then the question or the request.
        "frames as (select us, 14 + case when seq % 3 = 0 then 4 else 0 end + 20 + case when protocol in ('DNS', 'NTP') then 8 + 12 + 1 + length('a' || k) + 8 + 4 + 5 "
        "else 20 + length('GET /item/' || k || ' HTTP/1.1') + 2 + length('Host: h' || k % 7 || '.example.com') + 4 end as size from packets where dst not like '%:%')",
    ),
)
add(
    "src02_format_census",
    _census,
    over_packets(
        f"select case (piece + sensor) % {len(HEADS)} {_KINDS} else case when (piece + sensor) % 4 = 3 then 'pcapng' else 'pcap' end end as format, count(*) as n "
        f"from (select distinct seq // {PIECE} as piece, cast(substr(sensor, 8, 1) as int) as sensor from packets where dst not like '%:%') group by 1"
    ),
)


def _event_lines(s, d):
    e = F.to_json(F.array(F.struct(F.col("kind").alias("event_type"), F.col("src").alias("source_ip"), F.col("dport").alias("port"), F.col("sensor").alias("sensor_id"), F.when(F.col("k") % 10 == 0, "yesterday").otherwise("2024-01-02T03:04:05Z").alias("timestamp"))))
    return packets(s, d).select(e.alias("line"))


add(
    "src03_event_batch",
    lambda s, d: feeds.parse_events(_event_lines(s, d), "line", 1706000000000000, s.createDataFrame([("sensor-1",), ("sensor-2",)], "sensor_id string")).groupBy("event_type", "sensor_id", "us").agg(F.count("*").alias("n")),
    over_packets("select kind as event_type, case when sensor in ('sensor-1', 'sensor-2') then sensor end as sensor_id, case when k % 10 = 0 then 1706000000000000 else 1704164645000000 end as us, count(*) as n from packets group by all"),
)
add("src04_event_stream", lambda s, d: st.drain(st.packet_stream(s, d).select("seq", "kind", "us")).groupBy("kind").agg(F.count("*").alias("accepted")), over_packets("select kind, count(*) as accepted from packets group by kind"))
add("src05_indicators", lambda s, d: feeds.parse_indicators(table(s, d, "labels").selectExpr("case when doc_id % 9 = 0 then '# comment' else concat('  Bad', cast(doc_id % 50 as string), '.Example.COM # seen') end as value")), "select distinct concat('bad', doc_id % 50, '.example.com') as value from labels where doc_id % 9 <> 0")
add("src06_heartbeats", lambda s, d: joins.latest(heartbeats(s, d), "sensor_id", ["us", "seq"]).select("sensor_id", "us", "bps"), f"with {HEARTBEATS} select sensor_id, us, bps from (select *, row_number() over (partition by sensor_id order by us desc, seq desc) as r from heartbeats) where r = 1")
add("snk01_json_lines", lambda s, d: feeds.json_lines(packets(s, d).select("seq", "src", F.when(F.col("k") > 50, F.col("dport")).alias("dport"))), over_packets("select concat('{\"seq\":', seq, ',\"src\":\"', src, '\",\"dport\":', case when k > 50 then cast(dport as string) else 'null' end, '}') as value from packets"))
add("snk02_ndjson", lambda s, d: packets(s, d).select(F.to_json(F.struct("seq", F.when(F.col("k") > 50, F.col("kind")).alias("kind"))).alias("value")), over_packets("select concat('{\"seq\":', seq, case when k > 50 then concat(',\"kind\":\"', kind, '\"') else '' end, '}') as value from packets"))
add("snk03_timeline_csv", lambda s, d: packets(s, d).select("seq", feeds.csv_line(F.col("us"), F.concat(F.lit('say "'), "kind", F.lit('"')), F.when(F.col("k") > 50, F.col("dst"))).alias("line")), over_packets("select seq, concat('\"', us, '\",\"say \"\"', kind, '\"\"\",\"', case when k > 50 then dst else '' end, '\"') as line from packets"))


def _exported(s, d):
    a, b = new_folder(s, "export-a"), new_folder(s, "export-b")
    feeds.export_batches(st.packet_stream(s, d).select("seq", "kind"), [a, b], new_folder(s, "export-state")).awaitTermination()
    return s.read.parquet(a).groupBy("kind").agg(F.count("*").alias("n")).join(s.read.parquet(b).groupBy("kind").agg(F.sum("seq").alias("seq_sum")), "kind")


add("snk04_batched_export", _exported, over_packets("select kind, count(*) as n, cast(sum(seq) as bigint) as seq_sum from packets group by kind"))


def _rotated(s, d):
    path = new_folder(s, "rotated")
    feeds.write_rotated(packets(s, d).select("seq", "hour"), path, 100, F.col("hour"))
    files = s.read.parquet(path).select("hour_bucket", F.input_file_name().alias("file"))
    return files.groupBy("hour_bucket").agg(F.count("*").alias("n"), (F.countDistinct("file") >= F.ceil(F.count("*") / 100)).alias("rotated"))


add("snk05_rotation", _rotated, over_packets("select hour as hour_bucket, count(*) as n, true as rotated from packets group by hour"))


def _rotated_by_bytes(s, d):
    path = new_folder(s, "rotated")
    feeds.write_by_bytes(packets(s, d).select("us", "seq", F.concat_ws(",", "seq", "src", "summary").alias("value")), path, ["us", "seq"], 4000, 5)
    return s.read.text(path).groupBy(F.col("file").cast("long").alias("file")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))


add(
    "snk05_rotation_by_bytes",
    _rotated_by_bytes,
    over_packets(
        "select file, count(*) as n, cast(sum(size) as bigint) as bytes from (select *, max(file) over () as last from (select size, cast((sum(size) over (order by us, seq) - size) // 4000 as bigint) as file "
        "from (select us, seq, strlen(concat_ws(',', seq, src, summary)) + 1 as size from packets))) where file > last - 5 group by file"
    ),
)
add("snk06_metrics", lambda s, d: feeds.metric_lines(packets(s, d).groupBy("protocol", "sensor").agg(F.sum("length").alias("bytes")), "bytes_total", "bytes", ["protocol", "sensor"]), over_packets("select concat('bytes_total{protocol=\"', protocol, '\",sensor=\"', sensor, '\"} ', cast(sum(length) as bigint)) as value from packets group by protocol, sensor"))
add("snk07_report", lambda s, d: feeds.numbered_report(packets(s, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000)), ["us", "seq"], "day").select("number", "seq", "src"), over_packets("select row_number() over (order by us, seq) as number, seq, src from packets"))

# Streams: each is drained over the table and held against the batch form.
add("str01_tumbling", lambda s, d: st.drain(st.tumbling_rates(st.packet_stream(s, d), "1 hour"), "complete"), over_packets("select us // 3600000000 * 3600000000 as start_us, count(*) as packets, cast(sum(length) as bigint) as bytes from packets group by 1"))
add("str02_sliding", lambda s, d: st.drain(st.sliding_totals(st.packet_stream(s, d), "2 hours", "1 hour"), "complete"), over_packets("select (us // 3600000000 - o) * 3600000000 as start_us, count(*) as packets, cast(sum(length) as bigint) as bytes from packets, (values (0), (1)) v(o) group by 1"))
add(
    "str03_call_sessions",
    lambda s, d: st.drain(st.call_sessions(st.packet_stream(s, d).withColumn("closes", F.col("kind") == "purchase"), ["src", "protocol"], 60 * 86400)).where("finished").drop("finished"),
    over_packets("select src, protocol, min(us) as start_us, max(us) as end_us, count(*) as chunks, cast(sum(length) as bigint) as tokens from (select *, count(*) filter (kind = 'purchase') over (partition by src, protocol order by us, seq rows between unbounded preceding and 1 preceding) as i from packets) group by src, protocol, i having bool_or(kind = 'purchase')"),
)
add("str04_first_seen", lambda s, d: st.drain(st.first_seen(st.packet_stream(s, d, "60 days").select("dst", "at"), "dst")).select("dst"), over_packets("select distinct dst from packets"))
add("str05_cooldown", lambda s, d: st.drain(st.cooldown(st.packet_stream(s, d).where("kind = 'error'"), ["src"], 86400)), _cooldown_sql("select * from packets where kind = 'error'", "src", 86_400_000_000) + " select seq from r where fires")
add(
    "str06_absence",
    lambda s, d: st.drain(st.silent(st.packet_stream(s, d).where("kind = 'view'"), "src", 4 * 86400)).groupBy("src").agg(F.count("*").alias("n")),
    # Gaps before a later row, and the silence at the end where the watermark (the last row less 10 seconds) has passed it.
    over_packets(
        "select src, count(*) as n from (select src, us - lag(us) over (partition by src order by us, seq) > 345600000000 as silent from packets where kind = 'view' "
        "union all select src, (max(us) + 345600000000) // 1000 < (select max(us) // 1000 - 10000 from packets where kind = 'view') from packets where kind = 'view' group by src) where silent group by src"
    ),
)
add(
    "str07_rate_limit",
    lambda s, d: st.drain(st.rate_limited(st.packet_stream(s, d), "src", 3, 86400)),
    f"{_recursive}, n as (select *, row_number() over (partition by src order by us, seq) as i from packets), r as (select src, seq, i, us as start, 1 as used from n where i = 1 union all select n.src, n.seq, n.i, case when n.us - r.start >= 86400000000 then n.us else r.start end, case when n.us - r.start >= 86400000000 then 1 else r.used + 1 end from r join n on n.src = r.src and n.i = r.i + 1) select seq from r where used > 3",
)
add("str08_rolling_flows", lambda s, d: st.drain(st.rolling_flows(st.packet_stream(s, d), ["src", "dst"], "2 days"), "complete"), over_packets("select src, dst, min(us) as start_us, count(*) as packets, cast(sum(length) as bigint) as bytes from (select *, count(*) filter (gap is null or gap >= 172800000000) over (partition by src, dst order by us, seq) as i from (select *, us - lag(us) over (partition by src, dst order by us, seq) as gap from packets)) group by src, dst, i"))
add("str10_stop_conditions", lambda s, d: st.stop_after(packets(s, d), 200, 30000, 20 * 86400, partition="sensor").select("sensor", "seq"), over_packets("select sensor, seq from (select sensor, seq, row_number() over w as n, sum(length) over w - length as b, us - min(us) over w as t from packets window w as (partition by sensor order by seq)) where n <= 200 and b < 30000 and t <= 1728000000000"))
add(
    "str10_stop_stream",
    lambda s, d: st.drain(st.stop_stream(st.packet_stream(s, d), "sensor", 200, 30000, 20 * 86400)),
    over_packets("select seq from (select seq, row_number() over w as n, sum(length) over w - length as b, us - min(us) over w as t from packets window w as (partition by sensor order by us, seq)) where n <= 200 and b < 30000 and t <= 1728000000000"),
)
add("str13_live_baseline", lambda s, d: st.drain(st.live_baseline(st.packet_stream(s, d), "src", 2.5)), over_packets("select seq from (select seq, length, avg(length) over w as m, stddev_samp(length) over w as sd from packets window w as (partition by src order by us, seq rows between unbounded preceding and 1 preceding)) where sd > 0 and (length - m) / sd > 2.5"))
add("str13_live_scores", lambda s, d: st.drain(st.live_scores(st.packet_stream(s, d), "src", 10_000 * 86400), started_with=st.MANY_STATES).select("seq", "reasons", F.round("score", 5).alias("score")), _host_sql("src"))


def _message_stream(s, d):
    return st.packet_stream(s, d).where("kind <> 'error'").selectExpr("src", "dport", "us", "seq", "at", "kind in ('click', 'signup') as is_request", "case when k % 3 > 0 then concat('id', cast(k as string)) end as id")


add(
    "str14_stream_pairs",
    lambda s, d: st.drain(st.stream_pairs(_message_stream(s, d), ["src", "dport"], 86400 * 3)),
    # Row by row: who waits, then whom a response takes (by id the oldest, else the newest), then who waits on.
    f"{_recursive}, {MESSAGES}, n as (select *, row_number() over (partition by src, dport order by us, seq) as i from m), "
    "r as (select src, dport, i, seq, q, id, case when q then [struct_pack(s := seq, t := us, id := id)] else [] end as waits, cast(null as bigint) as taken, cast(null as varchar) as method from n where i = 1 "
    "union all select src, dport, i, seq, q, id, case when q then list_append(w, struct_pack(s := seq, t := us, id := id)) else list_filter(w, lambda x: x.s is distinct from coalesce(h, t)) end, "
    "case when not q then coalesce(h, t) end, case when not q then case when h is not null then 'header' when t is not null then 'timing' when id is not null then 'orphan' end end from "
    "(select *, list_filter(w, lambda x: x.id = id)[1].s as h, w[len(w)].s as t from (select n.*, list_filter(r.waits, lambda x: n.us - x.t <= 259200000000) as w from r join n on n.src = r.src and n.dport = r.dport and n.i = r.i + 1))) "
    "select taken as request_seq, seq as response_seq, case coalesce(method, case when id is not null then 'orphan' end) when 'header' then 0.95::double when 'timing' then 0.6::double else 0.5::double end as confidence, coalesce(method, 'orphan') as method "
    "from r where not q and (method is not null or (i = 1 and id is not null))",
)


def _decoder(data: bytes):
    return ("CUSTOM", f"{len(data)} bytes") if data[:1] == b"P" else None


add("udf01_decoder", lambda s, d: hooks.decode_unmatched(packets(s, d).select("seq", "dport", F.encode("summary", "UTF-8").alias("data")), F.col("dport") == 8080, "data", _decoder).select("seq", "decoded_protocol", "decoded_summary"), over_packets("select seq, case when dport = 8080 and kind = 'signup' then 'CUSTOM' end as decoded_protocol, case when dport = 8080 and kind = 'signup' then concat(length(summary), ' bytes') end as decoded_summary from packets"))


add(
    "udf02_aggregate",
    lambda s, d: hooks.aggregate_states(
        packets(s, d), ["src"], ["length"], "spread long",
        start=lambda: None,
        add=lambda ends, n: (n, n) if ends is None else (min(ends[0], n), max(ends[1], n)),
        merge=lambda a, b: (min(a[0], b[0]), max(a[1], b[1])),
        finish=lambda ends: (ends[1] - ends[0],),
    ),
    over_packets("select src, max(length) - min(length) as spread from packets group by src"),
)


def word_rows(summary: str):
    for word in (summary or "").split(" "):
        if word.isupper() and word.isalpha():
            yield (word,)


add("udf03_table_function", lambda s, d: hooks.table_function(packets(s, d).select("seq", "summary"), ["summary"], "word string", word_rows).groupBy("word").agg(F.count("*").alias("n")), over_packets("select word, count(*) as n from (select unnest(string_split(summary, ' ')) as word from packets) where regexp_matches(word, '^[A-Z]+$') group by word"))
RULES = [{"name": "big", "severity": "high", "when": {"op": "AND", "items": [{"field": "length", "cmp": "gt", "value": 1500}, {"field": "protocol", "cmp": "eq", "value": "HTTP"}]}}, {"name": "error", "severity": "low", "when": {"op": "OR", "items": [{"field": "kind", "cmp": "eq", "value": "error"}]}}]
add("udf04_rule_table", lambda s, d: hooks.apply_rule_table(packets(s, d), RULES, {c: c for c in ("length", "protocol", "kind")}).groupBy("rule", "rule_severity").agg(F.count("*").alias("n")), over_packets("select 'error' as rule, 'low' as rule_severity, count(*) as n from packets where kind = 'error' union all select 'big', 'high', count(*) from packets where length > 1500 and protocol = 'HTTP' having count(*) > 0"))
