"""Requests and responses: pairing by header, by event-stream id, by time; model calls: cost, quality, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filters

# Headers that carry a correlation id, in order of preference.
CORRELATION_HEADERS = ("x-request-id", "request-id", "x-goog-request-params", "apim-request-id", "traceparent", "x-trace-id")


def correlation_id(payload: Column) -> Column:
    """The id of the first header that is there, else null."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(payload, rf"(?im)^{h}:[ \t]*([^\r\n]+)", 1)), F.lit("")) for h in CORRELATION_HEADERS))


def pair_by_id(requests: DataFrame, responses: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """The k-th response of a key belongs to its k-th request. Both sides: keys, us, seq."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    q = requests.withColumn("_k", F.row_number().over(w)).select(*keys, "_k", F.col("seq").alias("request_seq"), F.col("us").alias("request_us"))
    r = responses.withColumn("_k", F.row_number().over(w)).select(*keys, "_k", F.col("seq").alias("response_seq"), F.col("us").alias("response_us"))
    return q.join(r, [*keys, "_k"]).where("response_us >= request_us").drop("_k").withColumn("confidence", F.lit(confidence))


def pair_by_time(requests: DataFrame, responses: DataFrame, keys: list[str], seconds: float = 5, confidence: float = 0.6) -> DataFrame:
    """Each response with the newest request of its key at or before it, if not older than the limit. One order per key, no range join."""
    q = requests.select(*keys, "us", "seq", F.lit(True).alias("_q"))
    both = q.unionByName(responses.select(*keys, "us", "seq", F.lit(False).alias("_q")))
    w = Window.partitionBy(*keys).orderBy("us", F.desc("_q"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_q"), F.struct("seq", "us")), True).over(w)
    out = both.withColumn("_l", last).where(~F.col("_q") & (F.col("us") - F.col("_l.us") <= int(seconds * 1_000_000)))
    return out.select(*keys, F.col("_l.seq").alias("request_seq"), F.col("_l.us").alias("request_us"), F.col("seq").alias("response_seq"), F.col("us").alias("response_us"), F.lit(confidence).alias("confidence"))


def orphans(responses: DataFrame, pairs: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Responses with an id that no pair has."""
    return responses.where("id is not null").join(pairs.select(F.col("response_seq").alias("seq")), "seq", "left_anti").withColumn("confidence", F.lit(confidence))


def pair_cascade(requests: DataFrame, responses: DataFrame, keys: list[str], seconds: float = 5) -> DataFrame:
    """By id, then by time for what is left, then orphans: one row per response that any step explains."""
    first = pair_by_id(requests.where("id is not null"), responses.where("id is not null"), [*keys, "id"], 0.95).withColumn("method", F.lit("header"))
    rest_q = requests.join(first.select(F.col("request_seq").alias("seq")), "seq", "left_anti")
    rest_r = responses.join(first.select(F.col("response_seq").alias("seq")), "seq", "left_anti")
    second = pair_by_time(rest_q, rest_r, keys, seconds).withColumn("method", F.lit("timing"))
    done = first.select("request_seq", "response_seq", "confidence", "method").union(second.select("request_seq", "response_seq", "confidence", "method"))
    third = orphans(responses, done).select(F.lit(None).cast("long").alias("request_seq"), F.col("seq").alias("response_seq"), "confidence", F.lit("orphan").alias("method"))
    return done.union(third)


def call_metadata(body: Column) -> dict[str, Column]:
    """model, finish, error and token counts from a JSON body, with the fields of the common APIs."""
    get = lambda path: F.get_json_object(body, path)
    return {
        "model": F.coalesce(get("$.model"), get("$.modelId")),
        "prompt_tokens": F.coalesce(get("$.usage.prompt_tokens"), get("$.usage.input_tokens")).cast("long"),
        "completion_tokens": F.coalesce(get("$.usage.completion_tokens"), get("$.usage.output_tokens")).cast("long"),
        "finish": F.coalesce(get("$.choices[0].finish_reason"), get("$.stop_reason")),
        "error": F.coalesce(get("$.error.type"), get("$.error.code")),
        "tool_calls": F.coalesce(F.json_array_length(get("$.choices[0].message.tool_calls")), F.lit(0)),
    }


# Fixed values: (words of which one is in the model's name, family), first match wins.
FAMILIES = (
    (("gpt-4", "gpt4"), "gpt-4"), (("gpt-3.5", "gpt-35"), "gpt-3.5"), (("o1", "o3"), "o-series"), (("claude-3", "claude3"), "claude-3"), (("claude-2", "claude2"), "claude-2"), (("claude",), "claude"),
    (("gemini-2.0", "gemini2.0"), "gemini-2.0"), (("gemini-1.5", "gemini1.5"), "gemini-1.5"), (("gemini-1.0", "gemini1.0", "gemini-pro"), "gemini-1.0"), (("gemini",), "gemini"),
    (("llama-3", "llama3"), "llama-3"), (("llama-2", "llama2"), "llama-2"), (("llama",), "llama"), (("mistral-large", "mistral_large"), "mistral-large"), (("mistral-medium", "mistral_medium"), "mistral-medium"),
    (("mistral-small", "mistral_small"), "mistral-small"), (("mistral",), "mistral"), (("mixtral",), "mixtral"), (("command-r", "command_r"), "command-r"), (("command",), "command"), (("deepseek",), "deepseek"),
    (("grok",), "grok"), (("dbrx", "dbrix"), "dbrx"), (("phi-3", "phi3", "phi-4", "phi4"), "phi"), (("qwen",), "qwen"), (("yi-", "yi/"), "yi"), (("gemma",), "gemma"), (("falcon",), "falcon"), (("bert",), "bert"), (("t5-", "t5_", "flan-t5"), "t5"),
)
# Provider, family, word in the name ("" for any), US dollars per million tokens in and out; first match wins.
PRICES = (
    ("openai", "gpt-4", "turbo", 10.0, 30.0), ("openai", "gpt-4", "32k", 60.0, 120.0), ("openai", "gpt-4", "", 30.0, 60.0), ("openai", "gpt-3.5", "16k", 3.0, 4.0), ("openai", "gpt-3.5", "", 0.5, 1.5),
    ("openai", "o-series", "mini", 1.1, 4.4), ("openai", "o-series", "", 15.0, 60.0), ("anthropic", "claude-3", "sonnet", 3.0, 15.0), ("anthropic", "claude-3", "haiku", 0.25, 1.25), ("anthropic", "claude-3", "opus", 15.0, 75.0),
    ("anthropic", "claude-2", "", 8.0, 24.0), ("anthropic", "claude", "", 8.0, 24.0), ("google", "gemini-2.0", "flash", 0.1, 0.4), ("google", "gemini-1.5", "pro", 1.25, 5.0), ("google", "gemini-1.5", "flash", 0.075, 0.3),
    ("google", "gemini-1.0", "", 0.5, 1.5), ("mistral", "mistral-large", "", 2.0, 6.0), ("mistral", "mistral-medium", "", 2.7, 8.1), ("mistral", "mistral-small", "", 1.0, 3.0), ("mistral", "mistral", "", 1.0, 3.0),
    ("mistral", "mixtral", "", 0.6, 2.4), ("cohere", "command-r", "plus", 3.0, 15.0), ("cohere", "command-r", "", 0.5, 1.5), ("cohere", "command", "", 0.5, 1.5), ("deepseek", "", "", 0.14, 0.28), ("xai", "grok", "", 5.0, 15.0),
    ("groq", "", "", 0.0, 0.0), ("together", "", "", 0.0, 0.0), ("fireworks", "", "", 0.0, 0.0), ("perplexity", "llama-3", "", 0.6, 1.8), ("", "llama-3", "70b", 0.59, 0.79), ("", "llama-3", "8b", 0.06, 0.08),
    ("", "llama-2", "70b", 0.7, 0.95), ("", "llama-2", "13b", 0.2, 0.25), ("", "mixtral", "8x7b", 0.3, 0.6), ("", "dbrx", "", 0.6, 2.4), ("", "phi", "medium", 0.1, 0.1),
    ("vllm", "", "", 0.0, 0.0), ("huggingface", "", "", 0.0, 0.0), ("nvidia", "", "", 0.0, 0.0), ("sglang", "", "", 0.0, 0.0), ("litellm", "", "", 0.0, 0.0),
)


def model_family(model: Column) -> Column:
    name, out = F.lower(model), F.lit("")
    for words, family in reversed(FAMILIES):
        out = F.when(filters.any_of(*(name.contains(w) for w in words)), family).otherwise(out)
    return F.coalesce(out, F.lit(""))


def with_cost(calls: DataFrame) -> DataFrame:
    """Adds family and cost in US dollars; null where no price fits. Prices are a small table joined on its conditions; the first row of
    the table that fits wins."""
    spark = calls.sparkSession
    prices = spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "priority int, p string, f string, word string, rate_in double, rate_out double")
    named = calls.withColumn("family", model_family(F.col("model")))
    kinds = named.select("provider", "model", "family").distinct()  # as many as there are models
    fits = ((F.col("p") == "") | (F.col("p") == F.col("provider"))) & ((F.col("f") == "") | (F.col("f") == F.col("family"))) & F.contains(F.lower("model"), F.col("word"))
    priced = kinds.join(F.broadcast(prices), fits).groupBy("provider", "model").agg(F.min_by(F.struct("rate_in", "rate_out"), "priority").alias("_r"))
    cost = (F.coalesce("prompt_tokens", F.lit(0)) * F.col("_r.rate_in") + F.coalesce("completion_tokens", F.lit(0)) * F.col("_r.rate_out")) / 1_000_000
    return named.join(priced, ["provider", "model"], "left").withColumn("cost", cost).drop("_r")


def call_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if("streaming").alias("streamed"), F.count_if(F.col("status") >= 400).alias("errors"))


def call_breakdown(calls: DataFrame) -> DataFrame:
    """Calls and tokens by model, provider, family and request type, from one pass (grouping sets)."""
    sets = [[F.col(c)] for c in ("model", "provider", "family", "request_type")]
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return calls.withColumn("_t", tokens).groupingSets(sets, "model", "provider", "family", "request_type").agg(F.count("*").alias("calls"), F.sum("_t").alias("tokens"))


# Upper ends of the latency buckets, ms.
LATENCY_BUCKETS = (100, 500, 1000, 5000, 30000)


def latency_buckets(calls: DataFrame, latency: str) -> DataFrame:
    bucket = F.lit(f">{LATENCY_BUCKETS[-1]}")
    for top in reversed(LATENCY_BUCKETS):
        bucket = F.when(F.col(latency) <= top, f"<={top}").otherwise(bucket)
    return calls.where(F.col(latency).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("calls"))


def model_quality(calls: DataFrame) -> DataFrame:
    """Per model: time to first token, time per token, tokens per second, shares of 4xx (429 apart), 5xx, 429, unfinished streams."""
    n = F.count("*")
    tpot = F.when((F.col("completion_tokens") > 0) & (F.col("stream_ms") > 0), F.col("stream_ms") / F.col("completion_tokens"))
    tps = F.when(F.col("stream_ms") > 0, F.col("completion_tokens") * 1000.0 / F.col("stream_ms"))
    status = F.col("status")
    return calls.groupBy("model").agg(
        n.alias("calls"),
        F.avg("ttft_ms").alias("avg_ttft"),
        F.avg(tpot).alias("avg_tpot"),
        F.avg(tps).alias("avg_tps"),
        (F.count_if(status.between(400, 499) & (status != 429)) / n).alias("rate_4xx"),
        (F.count_if(status.between(500, 599)) / n).alias("rate_5xx"),
        (F.count_if(status == 429) / n).alias("rate_429"),
        F.try_divide(F.count_if(F.col("streaming") & (F.col("finish") != "stop")), F.count_if("streaming")).alias("incomplete_rate"),
    )


def sla_breaches(calls: DataFrame) -> DataFrame:
    """A row per breach: metric and its limit. calls need cost."""
    status = F.col("status")
    talked = (F.col("completion_tokens") > 0) & (F.col("stream_ms") > 0)
    rules = (
        ("TTFT", F.col("ttft_ms") > 500), ("TPOT", talked & (F.col("stream_ms") / F.col("completion_tokens") > 80)), ("tokens/s", talked & (F.col("completion_tokens") * 1000.0 / F.col("stream_ms") < 20)), ("cost", F.col("cost") > 0.10),
        ("rate limit", status == 429), ("4xx", status.between(400, 499) & (status != 429)), ("5xx", status.between(500, 599)), ("stream broken", F.col("streaming") & (F.col("finish") != "stop")),
    )
    return calls.select("*", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))).alias("metric"))


def cost_by(calls: DataFrame, day: Column) -> DataFrame:
    """Cost per day and running cost over the days."""
    daily = calls.groupBy(day.alias("day")).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return daily.withColumn("running_cost", F.sum("cost").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # as many rows as days


def newest(calls: DataFrame, n: int, order: list[str]) -> DataFrame:
    return calls.orderBy(*(F.desc(c) for c in order)).limit(n)


def newest_mean(calls: DataFrame, key: str, value: str, n: int, order: list[str]) -> DataFrame:
    """Mean of the newest n rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return calls.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).groupBy(key).agg(F.avg(value).alias("mean"))


# Request types that never open a session.
NO_SESSION = ("moderation", "observability")


def sessions(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of a connection become sessions: one ends with a chunk that has a finish reason or an error, the next opens one.

    chunks: keys, us, seq, model, prompt_tokens, completion_tokens, total_tokens, cost, finish, error, request_type. Tokens and cost add
    up; total is the last, model the last that is not empty."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    closes = F.coalesce((F.col("finish") != "") | (F.col("error") != ""), F.lit(False)) | F.coalesce(F.col("finish") != "", F.lit(False)) | F.coalesce(F.col("error") != "", F.lit(False))
    s = chunks.where(~F.coalesce(F.col("request_type").isin(*NO_SESSION), F.lit(False))).withColumn("_c", closes)
    s = s.withColumn("session", F.coalesce(F.count_if("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*keys, "session").orderBy("us", "seq"))) / 1000
    s = s.withColumn("_gap", gap)
    at = F.struct("us", "seq")
    return s.groupBy(*keys, "session").agg(
        F.count("*").alias("chunks"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.max_by("total_tokens", F.when(F.col("total_tokens").isNotNull(), at)).alias("total_tokens"),
        F.sum("cost").alias("cost"),
        F.max_by("model", F.when(F.col("model") != "", at)).alias("model"),
        F.bool_or("_c").alias("closed"),
        F.avg("_gap").alias("mean_gap_ms"),
        F.max("_gap").alias("max_gap_ms"),
    )


def session_metrics(sessions_: DataFrame) -> DataFrame:
    """Adds stream_ms and tokens per second."""
    ms = (F.col("end_us") - F.col("start_us")) / 1000
    return sessions_.withColumns({"stream_ms": ms, "tokens_per_s": F.try_divide(F.col("completion_tokens") * 1000.0, ms)})


def merge_calls(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The last known value of each field over the rows of a call; complete once it has a finish reason or a total."""
    at = F.struct("us", "seq")
    out = rows.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))
    return out.withColumn("complete", F.col("finish").isNotNull() | F.col("total_tokens").isNotNull())


def retries_before(sessions_: DataFrame, retries: DataFrame, keys: list[str]) -> DataFrame:
    """Adds retries: how many of the key's retries fall after the previous session began and up to this one's start."""
    both = sessions_.select(*keys, F.col("start_us").alias("us"), "session").unionByName(retries.select(*keys, "us", F.lit(None).cast("long").alias("session")))
    w = Window.partitionBy(*keys).orderBy("us", F.col("session").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_n", F.count_if(F.col("session").isNull()).over(w)).where("session is not null")
    return counted.withColumn("retries", F.col("_n") - F.coalesce(F.lag("_n").over(Window.partitionBy(*keys).orderBy("us")), F.lit(0))).drop("_n")


def fabric_counters(rows: DataFrame, protocols: tuple[str, ...]) -> DataFrame:
    """One row: packets and bytes of each protocol."""
    p = F.col("protocol")
    return rows.agg(*(e for x in protocols for e in (F.count_if(p == x).alias(f"{x.lower()}_packets"), F.coalesce(F.sum(F.when(p == x, F.col("length"))), F.lit(0)).alias(f"{x.lower()}_bytes"))))


def prompt_fingerprint(text: Column, snippet: int = 40) -> dict[str, Column]:
    return {"sha256": F.sha2(F.encode(text, "UTF-8"), 256), "chars": F.length(text), "snippet": F.substring(text, 1, snippet)}
