"""The test tables as network data: packets, alerts, sensors and the like, for Spark and, as SQL text, for the oracle.

Event rows stand for packets: the user is the source, the number in props the destination and service, the value the length. The
expressions are plain SQL that both engines read alike, but for service and port. Times are also given as microseconds since 1970 (us), free of zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_K, DUCK_K = "cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"
EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"
#: Service and port by the last digit of the number in props; rows without a number have the last.
SERVICES = (("HTTP", 80), ("TLS", 443), ("DNS", 53), ("SSH", 22), ("SMB", 445), ("HTTP", 8080), ("RDP", 3389), ("NTP", 123), ("MODBUS", 502), ("TCP", 25))


def _place(values: list[str]) -> str:
    """Value of the last digit, as Spark SQL. A list and not a case, since a filter that is pushed below the columns holds their expressions
    in full: a case would then read the number out of props once a branch."""
    return f"coalesce(get(array({', '.join(values)}), k % 10), {values[-1]})"


def _branches(values: list[str]) -> str:
    """The same for the oracle."""
    return f"case k % 10 {' '.join(f'when {i} then {v}' for i, v in enumerate(values[:-1]))} else {values[-1]} end"


PACKET_COLUMNS = {
    "seq": "event_id",
    "src": "concat('10.', cast(user_id % 4 as string), '.', cast(cast(floor(user_id / 250) as bigint) % 250 as string), '.', cast(user_id % 250 as string))",
    "dst": "case when k < 60 then concat('192.168.1.', cast(k as string)) when k < 90 then concat('93.184.216.', cast(k as string)) else concat('2001:db8::', cast(k as string)) end",
    "sport": "cast(40000 + user_id % 10 as int)",
    "dport": _place([str(port) for _, port in SERVICES]),
    "protocol": _place([f"'{name}'" for name, _ in SERVICES]),
    "length": "cast(floor(value * 4) as bigint)",
    "flags": "cast(event_id % 32 as int)",
    "sensor": "concat('sensor-', cast(user_id % 4 as string))",
    "kind": "event_type",
    "summary": "case event_type when 'error' then concat('[TCP Retransmission] RST, ACK item ', cast(k as string)) when 'click' then concat('GET /item/', cast(k as string), ' HTTP/1.1') when 'view' then concat('Query A a', cast(k as string), '.example', cast(k % 5 as string), '.com NXDOMAIN') when 'signup' then concat('POST /signup password=x', cast(k as string)) else concat('HTTP/1.1 ', cast(200 + k * 4 as string), ' purchase SYN') end",
    "k": "k",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> str:
    """Microseconds since 1970 of a zone-free timestamp, as Spark SQL."""
    return f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} as timestamp_ntz))"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("*", f"{SPARK_K} as k")
    return events.selectExpr(*(f"{e} as {n}" for n, e in PACKET_COLUMNS.items()), f"{micros('ts')} as us", "hour(ts) as hour", "weekday(ts) as weekday")


_oracle = PACKET_COLUMNS | {"dport": f"cast({_branches([str(port) for _, port in SERVICES])} as int)", "protocol": _branches([f"'{name}'" for name, _ in SERVICES])}
_columns = ", ".join(f"{e} as {n}" for n, e in _oracle.items())
PACKETS = f"packets as (select {_columns}, epoch_us(ts) as us, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as weekday from (select *, {DUCK_K} as k from events))"


def over_packets(sql: str, *more: str) -> str:
    """The oracle's SQL with packets (and further named queries) in front."""
    return f"with {', '.join((PACKETS, *more))} {sql}"


#: Orders stand for alerts: status and severity, times in microseconds; an alert is resolved when its last line is shipped, if later.
ALERT_SQL = """alerts as (
  select o_orderkey as alert_id, o_custkey as sensor_id, o_orderkey % 7 as rule_id,
    case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'acknowledged' end as status,
    case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else 'info' end as severity,
    {created} as created_us, case when last_ship > o_orderdate then {resolved} end as resolved_us,
    concat('10.0.0.', cast(o_custkey % 200 as string)) as source_ip, o_totalprice as score
  from orders left join (select l_orderkey, max(l_shipdate) as last_ship from lineitem group by l_orderkey) on o_orderkey = l_orderkey)"""
ALERTS = ALERT_SQL.format(created="epoch_us(o_orderdate)", resolved="epoch_us(last_ship)")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    joined = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.selectExpr(
        "o_orderkey as alert_id",
        "o_custkey as sensor_id",
        "o_orderkey % 7 as rule_id",
        "case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'acknowledged' end as status",
        "case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else 'info' end as severity",
        f"{micros('o_orderdate')} as created_us",
        f"case when last_ship > o_orderdate then {micros('last_ship')} end as resolved_us",
        "concat('10.0.0.', cast(o_custkey % 200 as string)) as source_ip",
        "o_totalprice as score",
    )


#: Order lines stand for heartbeats of the sensor l_suppkey.
HEARTBEATS = "heartbeats as (select l_suppkey as sensor_id, epoch_us(l_shipdate) as us, l_orderkey * 10 + l_linenumber as seq, l_quantity * 1000 as bps, l_discount * 1000 as cpu, l_tax * 100 as drop_pct from lineitem)"


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as sensor_id", f"{micros('l_shipdate')} as us", "l_orderkey * 10 + l_linenumber as seq", "l_quantity * 1000 as bps", "l_discount * 1000 as cpu", "l_tax * 100 as drop_pct")


#: User turns with the assistant turn that follows stand for model calls; words are tokens, turns the clock.
CALL_MODELS = "case conv_id % 6 when 0 then 'gpt-4-turbo' when 1 then 'claude-3-sonnet' when 2 then 'gemini-1.5-pro' when 3 then 'llama-3-70b' when 4 then 'mistral-large' else 'deepseek-chat' end"
CALL_PROVIDERS = "case conv_id % 6 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'google' when 3 then 'together-ai' when 4 then 'mistral' else 'deepseek' end"
CALL_COLUMNS = {
    "call_id": "conv_id * 1000 + turn",
    "conv_id": "conv_id",
    "turn": "turn",
    "model": CALL_MODELS,
    "provider": CALL_PROVIDERS,
    "request_type": "case when turn < 2 then 'chat' else 'completion' end",
    "prompt_tokens": "cast(length(text) / 4 as bigint)",
    "completion_tokens": "cast(length(answer) / 4 as bigint)",
    "ttft_ms": "cast(length(text) % 900 as bigint)",
    "stream_ms": "cast(length(answer) * 3 as bigint)",
    "status": "cast(case (conv_id + turn) % 11 when 3 then 429 when 5 then 500 when 7 then 404 else 200 end as int)",
    "finish": "case when (conv_id + turn) % 9 = 4 then 'length' when answer is null then '' else 'stop' end",
    "streaming": "conv_id % 2 = 0",
}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    paired = turns.selectExpr("*", "lead(case when role = 'assistant' then text end) over (partition by conv_id order by turn) as answer")
    return paired.where("role = 'user'").selectExpr(*(f"{e} as {n}" for n, e in CALL_COLUMNS.items()))


_call_columns = ", ".join(f"{e.replace('/ 4 as', '// 4 as')} as {n}" for n, e in CALL_COLUMNS.items())
CALLS = f"calls as (select {_call_columns} from (select *, lead(case when role = 'assistant' then text end) over (partition by conv_id order by turn) as answer from conversations) where role = 'user')"
