"""Queries over pairing and model calls (PAIR-*, LLM-*), fingerprints and post-quantum handshakes (FP-*, PQC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as c
from ..operators import filters
from ..operators import handshakes as hs
from ..operators import stats
from ..sources.adapters import CALLS, calls, over_packets, packets, table
from .book import Book

BOOK = Book()
add = BOOK.add


def _messages(s, d):
    p = packets(s, d).where("kind <> 'error'").selectExpr("seq", "us", "src", "dport", "kind in ('click', 'signup') as is_request", "case when k % 3 > 0 then concat('id', cast(k as string)) end as id")
    return p.where("is_request"), p.where("not is_request")


MESSAGES = "m as (select seq, us, src, dport, kind in ('click', 'signup') as q, case when k % 3 > 0 then concat('id', k) end as id from packets where kind <> 'error')"
HEADER = "h as (select a.src, a.dport, a.id, a.seq as request_seq, a.us as request_us, b.seq as response_seq, b.us as response_us from (select *, row_number() over (partition by src, dport, id order by us, seq) as k from m where q and id is not null) a join (select *, row_number() over (partition by src, dport, id order by us, seq) as k from m where not q and id is not null) b on a.src = b.src and a.dport = b.dport and a.id = b.id and a.k = b.k where b.us >= a.us)"
add(
    "pair01_correlation_id",
    lambda s, d: packets(s, d).select("seq", c.correlation_id(F.concat(F.lit("GET / HTTP/1.1\r\n"), F.when(F.col("k") % 2 == 0, "X-Request-ID: r").otherwise("x-trace-id: t"), F.col("k").cast("string"), F.lit("\r\nhost: a\r\n"))).alias("id")),
    over_packets("select seq, concat(case when k % 2 = 0 then 'r' else 't' end, k) as id from packets"),
)
add("pair02_header_match", lambda s, d: c.pair_by_id(*(x.where("id is not null") for x in _messages(s, d)), ["src", "dport", "id"], 0.95).drop("request_us", "response_us"), over_packets("select src, dport, id, request_seq, response_seq, 0.95::double as confidence from h", MESSAGES, HEADER))
add("pair03_sse_match", lambda s, d: c.pair_by_id(*(x.where("id is not null") for x in _messages(s, d)), ["src", "id"], 0.8).groupBy("src").agg(F.count("*").alias("n")), over_packets("select a.src, count(*) as n from (select *, row_number() over (partition by src, id order by us, seq) as k from m where q and id is not null) a join (select *, row_number() over (partition by src, id order by us, seq) as k from m where not q and id is not null) b on a.src = b.src and a.id = b.id and a.k = b.k where b.us >= a.us group by a.src", MESSAGES))
TIMED = "t as (select r.src, r.dport, q.seq as request_seq, r.seq as response_seq from ({r}) r asof join ({q}) q on q.src = r.src and q.dport = r.dport and r.us >= q.us where r.us - q.us <= 86400000000)"
add("pair04_timing_match", lambda s, d: c.pair_by_time(*_messages(s, d), ["src", "dport"], 86400).select("request_seq", "response_seq", "confidence"), over_packets("select request_seq, response_seq, 0.6::double as confidence from t", MESSAGES, TIMED.format(r="select * from m where not q", q="select * from m where q")))


def _header_pairs(s, d):
    return c.pair_by_id(*(x.where("id is not null") for x in _messages(s, d)), ["src", "dport", "id"], 0.95)


add("pair05_orphans", lambda s, d: c.orphans(_messages(s, d)[1], _header_pairs(s, d)).select("seq", "id", "confidence"), over_packets("select seq, id, 0.5::double as confidence from m where not q and id is not null and seq not in (select response_seq from h)", MESSAGES, HEADER))
_cascade_sql = over_packets(
    "select method, count(*) as n, cast(sum(response_seq) as bigint) as seq_sum from (select 'header' as method, response_seq from h union all select 'timing', response_seq from t union all select 'orphan', seq from m where not q and id is not null and seq not in (select response_seq from h) and seq not in (select response_seq from t)) group by method",
    MESSAGES, HEADER, TIMED.format(r="select * from m where not q and seq not in (select response_seq from h)", q="select * from m where q and seq not in (select request_seq from h)"),
)
add("pair06_cascade", lambda s, d: c.pair_cascade(*_messages(s, d), ["src", "dport"], 86400).groupBy("method").agg(F.count("*").alias("n"), F.sum("response_seq").alias("seq_sum")), _cascade_sql)

add(
    "llm01_metadata",
    lambda s, d: calls(s, d).select("call_id", F.to_json(F.struct("model", F.struct("prompt_tokens", "completion_tokens").alias("usage"), F.array(F.struct(F.col("finish").alias("finish_reason"))).alias("choices"))).alias("body")).select("call_id", *(e.alias(n) for n, e in c.call_metadata(F.col("body")).items())),
    f"with {CALLS} select call_id, model, prompt_tokens, completion_tokens, finish, cast(null as string) as error, cast(0 as int) as tool_calls from calls",
)
add("llm02_family", lambda s, d: calls(s, d).groupBy("model", c.model_family(F.col("model")).alias("family")).agg(F.count("*").alias("n")), f"with {CALLS} select model, case model when 'gpt-4-turbo' then 'gpt-4' when 'claude-3-sonnet' then 'claude-3' when 'gemini-1.5-pro' then 'gemini-1.5' when 'llama-3-70b' then 'llama-3' when 'mistral-large' then 'mistral-large' else 'deepseek' end as family, count(*) as n from calls group by 1, 2")
PRICED = f"{CALLS}, priced as (select *, (coalesce(prompt_tokens, 0) * i + coalesce(completion_tokens, 0) * o) / 1000000 as cost from calls join (values ('gpt-4-turbo', 10.0::double, 30.0::double, 'gpt-4'), ('claude-3-sonnet', 3.0, 15.0, 'claude-3'), ('gemini-1.5-pro', 1.25, 5.0, 'gemini-1.5'), ('llama-3-70b', 0.59, 0.79, 'llama-3'), ('mistral-large', 2.0, 6.0, 'mistral-large'), ('deepseek-chat', 0.14, 0.28, 'deepseek')) v(m, i, o, family) on m = model)"
add("llm03_cost", lambda s, d: c.with_cost(calls(s, d)).select("call_id", F.round("cost", 9).alias("cost")), f"with {PRICED} select call_id, round(cost, 9) as cost from priced")
add("llm04_totals", lambda s, d: c.call_totals(calls(s, d)), f"with {CALLS} select count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, count(*) filter (streaming) as streamed, count(*) filter (status >= 400) as errors from calls")
add("llm05_breakdown", lambda s, d: c.call_breakdown(c.with_cost(calls(s, d))), f"with {PRICED} select model, provider, family, request_type, count(*) as calls, cast(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) as bigint) as tokens from priced group by grouping sets ((model), (provider), (family), (request_type))")
add("llm06_latency", lambda s, d: c.latency_buckets(calls(s, d), "stream_ms"), f"with {CALLS} select case when stream_ms <= 100 then '<=100' when stream_ms <= 500 then '<=500' when stream_ms <= 1000 then '<=1000' when stream_ms <= 5000 then '<=5000' when stream_ms <= 30000 then '<=30000' else '>30000' end as bucket, count(*) as calls from calls where stream_ms is not null group by 1")
_q = ("avg_ttft", "avg_tpot", "avg_tps", "rate_4xx", "rate_5xx", "rate_429", "incomplete_rate")
add(
    "llm07_quality",
    lambda s, d: c.model_quality(calls(s, d)).withColumns({n: F.round(n, 6) for n in _q}),
    f"with {CALLS} select model, count(*) as calls, round(avg(ttft_ms), 6) as avg_ttft, round(avg(case when completion_tokens > 0 and stream_ms > 0 then stream_ms / completion_tokens end), 6) as avg_tpot, round(avg(case when stream_ms > 0 then completion_tokens * 1000.0::double / stream_ms end), 6) as avg_tps, round(count(*) filter (status between 400 and 499 and status <> 429) / count(*), 6) as rate_4xx, round(count(*) filter (status between 500 and 599) / count(*), 6) as rate_5xx, round(count(*) filter (status = 429) / count(*), 6) as rate_429, round(count(*) filter (streaming and finish <> 'stop') / nullif(count(*) filter (streaming), 0), 6) as incomplete_rate from calls group by model",
)
add("llm08_breaches", lambda s, d: c.sla_breaches(c.with_cost(calls(s, d))).groupBy("metric").agg(F.count("*").alias("n")), f"with {PRICED} select metric, count(*) as n from (select unnest(list_filter([case when ttft_ms > 500 then 'TTFT' end, case when completion_tokens > 0 and stream_ms > 0 and stream_ms / completion_tokens > 80 then 'TPOT' end, case when completion_tokens > 0 and stream_ms > 0 and completion_tokens * 1000.0 / stream_ms < 20 then 'tokens/s' end, case when cost > 0.10 then 'cost' end, case when status = 429 then 'rate limit' end, case when status between 400 and 499 and status <> 429 then '4xx' end, case when status between 500 and 599 then '5xx' end, case when streaming and finish <> 'stop' then 'stream broken' end], lambda x: x is not null)) as metric from priced) group by metric")
add("llm09_cost_by_day", lambda s, d: c.cost_by(c.with_cost(calls(s, d)), F.floor(F.col("conv_id") / 10)).withColumns({"cost": F.round("cost", 7), "running_cost": F.round("running_cost", 7)}), f"with {PRICED} select day, round(cost, 7) as cost, round(sum(cost) over (order by day), 7) as running_cost from (select conv_id // 10 as day, sum(cost) as cost from priced group by 1)")
add("llm10_newest", lambda s, d: c.newest(calls(s, d), 100, ["conv_id", "turn"]).select("call_id", "stream_ms"), f"with {CALLS} select call_id, stream_ms from calls order by conv_id desc, turn desc limit 100")
add("llm10_newest_mean", lambda s, d: c.newest_mean(calls(s, d), "model", "ttft_ms", 20, ["conv_id", "turn"]).withColumn("mean", F.round("mean", 6)), f"with {CALLS} select model, round(avg(ttft_ms), 6) as mean from (select *, row_number() over (partition by model order by conv_id desc, turn desc) as i from calls) where i <= 20 group by model")


def _chunks(s, d):
    return packets(s, d).selectExpr("seq", "us", "src", "protocol", "case when k % 3 = 0 then '' else concat('m', cast(k % 4 as string)) end as model", "length as prompt_tokens", "cast(k as bigint) as completion_tokens", "case when k % 5 = 0 then length + k end as total_tokens", "length / 1000 as cost", "case when kind = 'purchase' then 'stop' end as finish", "case when kind = 'error' and k % 7 = 0 then 'overloaded' end as error", "case when k % 10 = 7 then 'moderation' else 'chat' end as request_type")


CHUNKS = "chunks as (select seq, us, src, protocol, case when k % 3 = 0 then '' else concat('m', k % 4) end as model, length, k, case when k % 5 = 0 then length + k end as total, kind = 'purchase' or (kind = 'error' and k % 7 = 0) as closes from packets where k % 10 <> 7), numbered as (select *, count(*) filter (closes) over (partition by src, protocol order by us, seq rows between unbounded preceding and 1 preceding) as session from chunks)"
SESSIONS = "sessions as (select src, protocol, session, count(*) as chunks, min(us) as start_us, max(us) as end_us, cast(sum(length) as bigint) as prompt_tokens, cast(sum(k) as bigint) as completion_tokens, arg_max(total, seq) filter (total is not null) as total_tokens, sum(length / 1000) as cost, arg_max(model, seq) filter (model <> '') as model, bool_or(closes) as closed from numbered group by all)"
_keys = ["src", "protocol"]
add("llm11_sessions", lambda s, d: c.sessions(_chunks(s, d), _keys).withColumn("cost", F.round("cost", 6)).drop("mean_gap_ms", "max_gap_ms"), over_packets("select * replace (round(cost, 6) as cost) from sessions", CHUNKS, SESSIONS))
add("llm12_session_metrics", lambda s, d: c.session_metrics(c.sessions(_chunks(s, d), _keys)).select("src", "protocol", "session", F.round("stream_ms", 3).alias("stream_ms"), F.round("tokens_per_s", 6).alias("tokens_per_s"), F.round("mean_gap_ms", 1).alias("mean_gap_ms")), over_packets("select s.src, s.protocol, s.session, round((end_us - start_us) / 1000, 3) as stream_ms, case when end_us > start_us then round(completion_tokens * 1000.0::double / ((end_us - start_us) / 1000), 6) end as tokens_per_s, case when chunks > 1 then round((end_us - start_us) / 1000 / (chunks - 1), 1) end as mean_gap_ms from sessions s", CHUNKS, SESSIONS))
add("llm13_merge_calls", lambda s, d: c.merge_calls(_chunks(s, d), _keys, ["model", "total_tokens", "finish"]), over_packets("select src, protocol, arg_max(case when k % 3 = 0 then '' else concat('m', k % 4) end, seq) as model, arg_max(length + k, seq) filter (k % 5 = 0) as total_tokens, case when count(*) filter (kind = 'purchase') > 0 then 'stop' end as finish, count(*) filter (kind = 'purchase' or k % 5 = 0) > 0 as complete from packets group by all"))
add("llm14_retries", lambda s, d: c.retries_before(c.sessions(_chunks(s, d), _keys), packets(s, d).where("kind = 'error'").select("src", "protocol", "us"), _keys).select("src", "protocol", "session", "retries"), over_packets("select s.src, s.protocol, s.session, count(e.us) as retries from (select *, lag(start_us) over (partition by src, protocol order by start_us) as before from sessions) s left join packets e on e.kind = 'error' and e.src = s.src and e.protocol = s.protocol and e.us <= s.start_us and (before is null or e.us > before) group by all", CHUNKS, SESSIONS))
add("llm15_no_openers", lambda s, d: c.sessions(_chunks(s, d), _keys).agg(F.count("*").alias("sessions"), F.sum("chunks").alias("chunks")), over_packets("select count(*) as sessions, cast(sum(chunks) as bigint) as chunks from sessions", CHUNKS, SESSIONS))
add("llm16_fabric", lambda s, d: c.fabric_counters(packets(s, d), ("DNS", "TLS", "SMB")), over_packets("select " + ", ".join(f"count(*) filter (protocol = '{p}') as {p.lower()}_packets, cast(sum(length) filter (protocol = '{p}') as bigint) as {p.lower()}_bytes" for p in ("DNS", "TLS", "SMB")) + " from packets"))
add("llm17_fingerprint", lambda s, d: table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", *(e.alias(n) for n, e in c.prompt_fingerprint(F.col("text")).items())), "select conv_id, turn, sha256(text) as sha256, cast(length(text) as int) as chars, substring(text, 1, 40) as snippet from conversations where role = 'user'")


def _hellos(s, d):
    """Client hellos from vectors: array columns of small numbers with GREASE among them."""
    v = F.transform("embedding", lambda x: F.abs(F.round(x * 1000)).cast("int"))
    return table(s, d, "embeddings").select("vec_id", "label", v.alias("v")).select("vec_id", "label", F.concat(F.array(F.lit(0x0A0A)), F.slice("v", 1, 6)).alias("ciphers"), F.concat(F.array(F.lit(0), F.lit(0x1A1A), F.lit(16)), F.slice("v", 7, 4)).alias("extensions"), F.slice("v", 11, 3).alias("groups"), F.array(F.lit(0)).alias("formats"), F.slice("v", 14, 2).alias("sig_algs"), F.array(F.lit(0x0304), F.lit(0x0303)).alias("versions"), F.array(F.lit("h2")).alias("alpn"), F.when(F.col("label") % 2 == 0, "a.example").alias("sni"))


HELLOS = "v as (select vec_id, label, list_transform(embedding, lambda x: cast(abs(round(x::double * 1000)) as int)) as v from embeddings), hellos as (select vec_id, label, v[1:6] as ciphers, list_concat([0, 16], v[7:10]) as extensions, v[11:13] as groups, v[14:15] as sig_algs from v)"
_join = lambda col: f"array_to_string({col}, '-')"
_hex4 = lambda col: f"list_transform({col}, lambda x: lpad(lower(to_hex(x)), 4, '0'))"
add("fp01_ja3", lambda s, d: _hellos(s, d).select("vec_id", F.md5(hs.ja3_text(F.lit(771), F.col("ciphers"), F.col("extensions"), F.col("groups"), F.col("formats"))).alias("ja3")), f"with {HELLOS} select vec_id, md5(concat('771,', {_join('ciphers')}, ',', {_join('extensions')}, ',', {_join('groups')}, ',0')) as ja3 from hellos")
add("fp02_ja3s", lambda s, d: _hellos(s, d).select("vec_id", F.md5(hs.ja3s_text(F.lit(771), F.col("ciphers")[1], F.col("extensions"))).alias("ja3s")), f"with {HELLOS} select vec_id, md5(concat('771,', ciphers[1], ',', {_join('extensions')})) as ja3s from hellos")
JA4 = f"concat('t13', case when label % 2 = 0 then 'd' else 'i' end, '0606h2_', substr(sha256(array_to_string(list_sort({_hex4('ciphers')}), ',')), 1, 12), '_', substr(sha256(concat(array_to_string(list_sort({_hex4('list_filter(extensions[3:6], lambda x: x not in (0, 16))')}), ','), '_', array_to_string({_hex4('sig_algs')}, ','))), 1, 12))"


def _ja4(s, d):
    return _hellos(s, d).select("vec_id", "label", hs.ja4(F.lit(771), *(F.col(x) for x in ("ciphers", "extensions", "sig_algs", "versions", "alpn", "sni"))).alias("ja4"))


_ja4_rows = f"with {HELLOS} select vec_id, label, {JA4} as ja4 from hellos"
add("fp03_ja4", lambda s, d: _ja4(s, d).drop("label"), f"select vec_id, ja4 from ({_ja4_rows})")
add(
    "flt11_tls_fields",
    lambda s, d: _hellos(s, d).withColumns({"ja3": F.md5(hs.ja3_text(F.lit(771), F.col("ciphers"), F.col("extensions"), F.col("groups"), F.col("formats")))}).where(filters.text_leaf("ja3", "contains", "A1") & filters.text_leaf("sni", "eq", "A.EXAMPLE")).select("vec_id"),
    f"with {HELLOS} select vec_id from hellos where contains(md5(concat('771,', {_join('ciphers')}, ',', {_join('extensions')}, ',', {_join('groups')}, ',0')), 'a1') and label % 2 = 0",
)
add("fp04_census", lambda s, d: hs.fingerprint_census(_hellos(s, d).select("label", F.md5(F.array_join(F.slice("extensions", 4, 1), "-")).alias("fp")), "fp", "label"), f"with {HELLOS} select md5(cast(extensions[3] as string)) as fp, count(*) as uses, count(distinct label) as hosts, count(distinct label) = 1 as rare from hellos group by 1")

KEM = "case k % 6 when 0 then 'ML-KEM-512' when 1 then 'ML-KEM-768' when 2 then 'X25519MLKEM768' when 3 then 'SIKEp434' end"
HS_COLUMNS = (
    "seq",
    "us",
    "src",
    "concat('s', cast(k % 15 as string)) as server_name",
    f"{KEM} as kem",
    "k % 6 = 2 as hybrid",
    "kind = 'view' as pqc_signature",
    "kind <> 'error' as success",
    "case when k % 4 = 0 then '1.2' else '1.3' end as tls_version",
    "length as kem_us",
    "length % 90 as overhead_ms",
    "length * 2 as total_ms",
    "900 + k * 10 as hello_size",
    "case when k % 9 = 0 then 1024 else 2048 end as rsa_bits",
    "k as days_left",
    "case when kind = 'error' and k % 2 = 0 then 'size' when kind = 'error' then 'version' end as fallback",
    "case when k % 8 = 0 then 'SHA1' else 'SHA256' end as cert_hash",
)
H = f"h as (select {', '.join(HS_COLUMNS)} from packets)"


def handshakes(s, d):
    return packets(s, d).selectExpr(*HS_COLUMNS).withColumn("offers", F.array_compact(F.array(F.col("kem"), F.lit("X25519"))))


add("pqc01_adoption", lambda s, d: hs.adoption(handshakes(s, d).where("kem is not null").withColumn("algorithm", F.col("kem")), ["src", "server_name"]).withColumn("algorithms", F.array_join("algorithms", ",")), over_packets("select src, server_name, count(*) as packets, array_to_string(list_sort(list_distinct(list(kem))), ',') as algorithms, min(us) as first_us, max(us) as last_us, bool_or(hybrid) as hybrid from h where kem is not null group by all", H))
add("pqc02_hybrid_ratio", lambda s, d: hs.hybrid_ratio(hs.adoption(handshakes(s, d).where("kem is not null").withColumn("algorithm", F.col("kem")), ["src", "server_name"])).select(F.round("hybrid_ratio", 6).alias("hybrid_ratio")), over_packets("select round(avg(case when hy then 1.0::double else 0 end), 6) as hybrid_ratio from (select bool_or(hybrid) as hy from h where kem is not null group by src, server_name)", H))
add("pqc02_top_algorithms", lambda s, d: hs.top_values(handshakes(s, d), "kem", 3), over_packets("select kem, count(*) as n from h where kem is not null group by kem order by n desc, kem limit 3", H))
add("pqc03_levels", lambda s, d: hs.level_distribution(handshakes(s, d).where("kem is not null"), "kem"), over_packets("select count(*) filter (kem = 'ML-KEM-512') as level1, count(*) filter (kem in ('ML-KEM-768', 'X25519MLKEM768')) as level3, cast(0 as bigint) as level5, count(*) filter (kem = 'SIKEp434') as unknown from h", H))
add("pqc04_dashboard", lambda s, d: hs.dashboard(handshakes(s, d)).withColumns({n: F.round(n, 6) for n in ("adoption_rate", "failure_rate", "pqc_certificate_rate")}), over_packets("select count(*) as handshakes, round(count(kem) / count(*), 6) as adoption_rate, round(count(*) filter (not success) / count(*), 6) as failure_rate, round(count(*) filter (pqc_signature) / count(*), 6) as pqc_certificate_rate from h", H))
add("pqc05_kem_distribution", lambda s, d: hs.kem_distribution(handshakes(s, d)), over_packets("select name, count(*) as n from (select kem as name from h where kem is not null union all select kem from h where kem is not null union all select 'X25519' from h) group by name", H))
add("pqc06_overhead", lambda s, d: stats.summary_stats(handshakes(s, d).where("kem is not null"), "overhead_ms", ["kem"]).withColumn("avg", F.round("avg", 6)), over_packets("select kem, l[1] as min, l[len(l)] as max, round(a, 6) as avg, l[len(l) // 2 + 1] as median, l[least(cast(ceil(len(l) * 0.95) as bigint), len(l) - 1) + 1] as p95 from (select kem, list(overhead_ms order by overhead_ms) as l, avg(overhead_ms) as a from h where kem is not null group by kem)", H))
add("pqc07_fallbacks", lambda s, d: hs.top_values(handshakes(s, d), "fallback", 5), over_packets("select fallback, count(*) as n from h where fallback is not null group by fallback order by n desc, fallback limit 5", H))
add(
    "pqc08_rule_scan",
    lambda s, d: hs.scan_rules(handshakes(s, d)).groupBy("finding").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")),
    over_packets("select finding, count(*) as n, cast(sum(seq) as bigint) as seq_sum from (select seq, unnest(list_filter([case when kem is null then 'NO_PQC' end, case when kem is null and coalesce(before, false) then 'DOWNGRADE' end, case when not success then 'FAILED' end, case when not pqc_signature then 'CLASSICAL_SIGNATURE' end, case when tls_version <> '1.3' then 'OLD_TLS' end, case when overhead_ms > 50 then 'SLOW' end, case when hello_size > 1400 then 'LARGE_HELLO' end, case when rsa_bits < 2048 then 'WEAK_RSA' end, case when days_left < 14 then 'EXPIRING' end, case when kem = 'SIKEp434' then 'BROKEN_KEM' end], lambda x: x is not null)) as finding from (select *, lag(kem is not null) over (partition by server_name order by us, seq) as before from h)) group by finding", H),
)
OVER = "o as (select count(*) as total, count(kem) * 100.0::double / count(*) as a, count(*) filter (hybrid) * 100.0::double / count(*) as hy, count(*) filter (not success) * 100.0::double / count(*) as f, count(*) filter (pqc_signature) * 100.0::double / count(*) as c, avg(overhead_ms) as oh, count(fallback) as fb, count(*) filter (tls_version <> '1.3') as ot, count(*) filter (cert_hash = 'SHA1') as wh from h)"
add("pqc09_overview", lambda s, d: hs.overview(handshakes(s, d)).select("total", F.round("adoption_pct", 6).alias("adoption_pct"), F.round("failure_pct", 6).alias("failure_pct"), "risk_score"), over_packets("select total, round(a, 6) as adoption_pct, round(f, 6) as failure_pct, cast(least(100, case when a = 0 then 90 when a < 10 then 75 when a > 80 then 15 when a > 50 then 35 else 55 end + case when f > 20 then 20 when f > 5 then 10 else 0 end) as int) as risk_score from o", H, OVER))
add("pqc10_kem_details", lambda s, d: hs.kem_details(handshakes(s, d)).withColumn("mean_us", F.round("mean_us", 6)), over_packets("select kem, count(*) as n, count(*) filter (not success) as failures, round(avg(kem_us) filter (success), 6) as mean_us from h where kem is not null group by kem", H))
add("pqc11_stages", lambda s, d: hs.stage_metrics(handshakes(s, d)).withColumns({"success_rate": F.round("success_rate", 6), "overhead_vs_classical": F.round("overhead_vs_classical", 6)}), over_packets("select count(distinct server_name) as servers, round(count(*) filter (success) / count(*), 6) as success_rate, round(avg(total_ms) filter (kem is not null) - avg(total_ms) filter (kem is null), 6) as overhead_vs_classical, count(*) filter (kem is null and server_name in (select server_name from h where kem is not null)) as downgraded from h", H))
add("pqc12_population", lambda s, d: hs.population_findings(handshakes(s, d)), over_packets("select * from (select 'failures' as finding, case when count(*) filter (not success) * 10 >= count(*) then count(*) filter (not success) else 0 end as n from h union all select 'classical signature', count(*) from h where not pqc_signature union all select 'level 1 mechanism', count(*) from h where kem = 'ML-KEM-512' union all select 'weak certificate hash', count(*) from h where cert_hash = 'SHA1' union all select 'TLS 1.2', count(*) from h where tls_version = '1.2' union all select 'broken mechanism', count(*) from h where kem = 'SIKEp434' union all select concat('fallback: ', fallback), count(*) from h where fallback is not null group by fallback) where n > 0", H))
add("pqc13_compliance", lambda s, d: hs.compliance(hs.overview(handshakes(s, d))), over_packets("select flag, met from (select unnest(['mechanisms in use', 'majority adopted', 'hybrid in use', 'TLS 1.3 only', 'no weak hash']) as flag, unnest([a > 0, a >= 50, hy > 0, ot = 0, wh = 0]) as met from o)", H, OVER))
add("pqc14_recommendations", lambda s, d: hs.recommendations(hs.overview(handshakes(s, d))), over_packets("select recommendation from (select unnest([case when a < 50 then 'raise adoption' end, case when hy > 50 then 'plan pure mechanisms' end, case when c < 50 then 'add composite certificates' end, case when oh > 10 then 'reduce latency' end, case when wh > 0 then 'replace weak hashes' end, case when fb > 0 then 'look into fallbacks' end, case when ot > 0 then 'retire TLS 1.2' end]) as recommendation from o) where recommendation is not null", H, OVER))
