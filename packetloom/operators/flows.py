"""Conversations: keys, tables, TCP anomalies, streams, merging and cutting captures, service latency, traces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import scalars
from ..sources.scratch import settled
from . import blocks, filters, folds


def with_flow_key(rows: DataFrame) -> DataFrame:
    """Adds flow_lo, flow_hi (the two ends in address order) and transport; rows without both addresses go. Addresses are ordered as
    numbers, IPv4 before IPv6."""
    end = lambda ip, port: F.struct(scalars.ip_sort_key(F.col(ip)).alias("key"), F.col(port).alias("port"), F.col(ip).alias("ip"))
    known = rows.where("src is not null and dst is not null").withColumns({"_a": end("src", "sport"), "_b": end("dst", "dport")})
    shown = lambda e: F.concat(e["ip"], F.lit(":"), F.coalesce(e["port"].cast("string"), F.lit("")))
    return known.withColumns({"flow_lo": shown(F.least("_a", "_b")), "flow_hi": shown(F.greatest("_a", "_b")), "transport": filters.transport()}).drop("_a", "_b")


FLOW_KEY = ["flow_lo", "flow_hi", "transport"]


def flow_table(rows: DataFrame) -> DataFrame:
    """One row per conversation: client (sender of the first packet), packets and bytes each way, first and last time, protocol of the
    highest rank (the first of equals), last summary, first sequence number. One shuffle: direction is counted for both ends and
    chosen once the client is known."""
    keyed = with_flow_key(rows).withColumn("_from_lo", F.concat("src", F.lit(":"), F.coalesce(F.col("sport").cast("string"), F.lit(""))) == F.col("flow_lo"))
    first, rank = F.struct("us", "seq"), F.struct(filters.protocol_rank(), -F.col("seq"))
    out = keyed.groupBy(*FLOW_KEY).agg(
        F.count("*").alias("packets"),
        F.sum("length").alias("bytes"),
        F.count_if("_from_lo").alias("_lo_packets"),
        F.coalesce(F.sum(F.when(F.col("_from_lo"), F.col("length"))), F.lit(0)).alias("_lo_bytes"),
        F.min_by("_from_lo", first).alias("_client_lo"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.max_by("protocol", rank).alias("protocol"),
        F.max_by("summary", "seq").alias("last_summary"),
        F.min("seq").alias("first_seq"),
    )
    side = lambda lo, total: F.when(F.col("_client_lo"), F.col(lo)).otherwise(F.col(total) - F.col(lo))
    out = out.withColumns({"client": F.when(F.col("_client_lo"), F.col("flow_lo")).otherwise(F.col("flow_hi")), "server": F.when(F.col("_client_lo"), F.col("flow_hi")).otherwise(F.col("flow_lo")), "sent_packets": side("_lo_packets", "packets"), "sent_bytes": side("_lo_bytes", "bytes")})
    return out.withColumns({"received_packets": F.col("packets") - F.col("sent_packets"), "received_bytes": F.col("bytes") - F.col("sent_bytes")}).drop("_lo_packets", "_lo_bytes", "_client_lo")


def with_duration(flows: DataFrame) -> DataFrame:
    return flows.withColumns({"duration_us": F.col("end_us") - F.col("start_us"), "byte_count": F.col("bytes")})


def tcp_tags(segments: DataFrame, flow: list[str], tcp_seq: str = "tcp_seq", payload: str = "payload_len", ack: str = "ack", win: str = "win", order: str = "seq") -> DataFrame:
    """Adds tag: Retransmission (a sequence number seen before in the flow), Out-of-Order (below the highest so far), Dup ACK #n (n-th repeat
    of a bare acknowledgement), else null."""
    w = Window.partitionBy(*flow).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("_data", F.col(payload) > 0)
    s = s.withColumns({"_seen": F.count_if("_data").over(Window.partitionBy(*flow, tcp_seq).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), "_top": F.max(tcp_seq).over(before)})
    same = ~F.col("_data") & ~F.lag("_data").over(w) & (F.lag(ack).over(w) == F.col(ack)) & (F.lag(win).over(w) == F.col(win))
    s = s.withColumn("_dup", F.coalesce(same, F.lit(False))).withColumn("_island", F.count_if(~F.col("_dup")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_n", F.count_if("_dup").over(Window.partitionBy(*flow, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    tag = F.when(F.col("_data") & (F.col("_seen") > 0), "Retransmission").when(F.col("_data") & (F.col(tcp_seq) < F.col("_top")), "Out-of-Order").when(F.col("_dup"), F.concat(F.lit("Dup ACK #"), F.col("_n").cast("string")))
    return s.withColumn("tag", tag).drop("_data", "_seen", "_top", "_dup", "_island", "_n")


def flow_experts(rows: DataFrame, flow: list[str], low_ms: float = 0.1, high_ms: float = 5000.0) -> DataFrame:
    """Per flow: packets, retransmissions, out-of-order, zero windows, mean gap (ms, only gaps within the bounds), loss % and health."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*flow).orderBy("us", "seq"))) / 1000
    s = F.col("summary")
    g = rows.withColumn("_gap", gap).groupBy(*flow).agg(
        F.count("*").alias("packets"),
        F.count_if(s.contains("[TCP Retransmission]")).alias("retransmissions"),
        F.count_if(s.contains("[TCP Out-of-Order]")).alias("out_of_order"),
        F.count_if(s.contains("ZeroWindow")).alias("zero_windows"),
        F.avg(F.when((F.col("_gap") > low_ms) & (F.col("_gap") < high_ms), F.col("_gap"))).alias("mean_gap_ms"),
    )
    loss = F.col("retransmissions") * 100.0 / F.col("packets")
    return g.withColumn("loss_pct", loss).withColumn("health", F.lit(100.0) - F.least(5 * F.col("loss_pct"), F.lit(50.0)) - F.least(F.col("out_of_order") * 3.0, F.lit(20.0)) - F.least(F.col("zero_windows") * 10.0, F.lit(30.0)))


def follow(rows: DataFrame, seq: int, payload: str = "summary") -> DataFrame:
    """The packets of one packet's conversation in order, with direction and running bytes."""
    keyed = with_flow_key(rows)
    wanted = keyed.where(F.col("seq") == seq).select(*FLOW_KEY, F.col("src").alias("_from"))
    w = Window.partitionBy(*FLOW_KEY).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    mine = keyed.join(F.broadcast(wanted), FLOW_KEY)  # one row
    return mine.select("seq", F.when(F.col("src") == F.col("_from"), "out").otherwise("in").alias("direction"), payload, F.sum("length").over(w).alias("total_bytes"))


def reassemble(segments: DataFrame, flow: list[str], tcp_seq: str = "tcp_seq", data: str = "data", order: str = "seq") -> DataFrame:
    """(flow, stream, segments): payloads in the order of sequence numbers; of a repeated number the last stays. A stream is one value: for
    long ones, use stream_segments."""
    last = segments.groupBy(*flow, tcp_seq).agg(F.max_by(data, order).alias("_d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(tcp_seq, "_d"))), lambda x: x["_d"]), "")
    return last.groupBy(*flow).agg(joined.alias("stream"), F.count("*").alias("segments"))


def stream_segments(segments: DataFrame, flow: list[str], tcp_seq: str = "tcp_seq", data: str = "data", order: str = "seq", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """(flow, tcp_seq, offset, data): a stream as its segments, each with the place at which it begins; of a repeated sequence number the last
    stays, empty ones go. No task holds a stream. data: binary."""
    last = segments.groupBy(*flow, tcp_seq).agg(F.max_by(data, order).alias("data")).where(F.octet_length("data") > 0)
    return blocks.preceding(last, flow, [tcp_seq], F.octet_length("data").cast("long"), "offset", block_rows).select(*flow, tcp_seq, "offset", "data")


#: Bytes of a stream that are searched as one piece.
PIECE_BYTES = 1 << 16


def stream_pieces(segments: DataFrame, flow: list[str], overlap: int, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(flow, begin, data): the stream in pieces of equal length, each with `overlap` bytes of the next, from segments (flow, offset, data): each
    segment is cut and dealt to the pieces that it reaches into, so that a piece is a bounded group."""
    end = F.col("offset") + F.octet_length("data")
    first, last = F.greatest(F.lit(0), F.floor((F.col("offset") - overlap) / piece_bytes)), F.floor((end - 1) / piece_bytes)
    dealt = segments.select(*flow, "offset", "data", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_piece"))
    begin, stop = F.col("_piece") * piece_bytes, (F.col("_piece") + 1) * piece_bytes + overlap
    start = F.greatest(begin, F.col("offset"))
    part = F.substring("data", (start - F.col("offset") + 1).cast("int"), (F.least(stop, end) - start).cast("int"))
    parts = dealt.select(*flow, "_piece", start.alias("_at"), part.alias("_part")).where(F.octet_length("_part") > 0)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.hex("_part").alias("_part")))), lambda x: x["_part"]), "")
    return parts.groupBy(*flow, "_piece").agg(whole.alias("_hex")).select(*flow, (F.col("_piece") * piece_bytes).alias("begin"), F.unhex("_hex").alias("data"))


def timeline(rows: DataFrame) -> DataFrame:
    return rows.select("us", "seq", "src", "dst", "protocol", "summary").orderBy("us", "seq")


def around(rows: DataFrame, triggers: DataFrame, before_s: int, after_s: int) -> DataFrame:
    """(trigger_id, row): rows within [t - before, t + after] of each trigger (trigger_id, t_us). Joined on time buckets as wide as the
    window, so that each trigger meets two or three buckets."""
    width = (before_s + after_s) * 1_000_000
    spans = triggers.withColumns({"_from": F.col("t_us") - before_s * 1_000_000, "_to": F.col("t_us") + after_s * 1_000_000})
    buckets = spans.select("trigger_id", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))).alias("_bucket"))
    return rows.withColumn("_bucket", F.floor(F.col("us") / width)).join(buckets, "_bucket").where("us between _from and _to").drop("_bucket", "_from", "_to")


def merge_captures(captures: list[DataFrame], chronological: bool = True) -> DataFrame:
    """All rows with file_idx; in time order (stable by input order) or one input after the other. Inputs carry us and seq."""
    out = None
    for i, c in enumerate(captures):
        part = c.withColumn("file_idx", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(*(("us",) if chronological else ()), "file_idx", "seq")


def split_by_packets(rows: DataFrame, keys: list[str], n: int, order: str = "seq") -> DataFrame:
    """Adds chunk: n rows each, within each of the keys."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / n))


def seek(rows: DataFrame, us: int) -> DataFrame:
    """The first row at or after a time."""
    return rows.where(F.col("us") >= us).orderBy("us", "seq").limit(1)


def page(rows: DataFrame, start: int, count: int, order: list[str]) -> DataFrame:
    """Rows start .. start + count - 1 of the order: a limit for each task and an offset, never a total sort."""
    return rows.orderBy(*order).offset(start).limit(count)


def service_calls(steps: DataFrame) -> DataFrame:
    """Latency from client payloads to the server payloads that follow.

    steps: flow_id, from_client, syn, ack, payload_len, ms, order, server, client. One call is outstanding at a time: the last client
    payload before the first server payload after it. Returns per client and server: count, median, max, network_ms (SYN to SYN/ACK).
    """
    w = Window.partitionBy("flow_id").orderBy("ms", "seq")
    s = steps.withColumn("_kind", F.when((F.col("payload_len") > 0) & F.col("from_client"), "q").when((F.col("payload_len") > 0) & ~F.col("from_client"), "r"))
    talk = s.where("_kind is not null")
    first_of_run = F.coalesce(F.lag("_kind").over(w) != F.col("_kind"), F.lit(True))
    asked = F.max(F.when((F.col("_kind") == "q") & F.col("_first"), F.col("ms"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    calls = talk.withColumn("_first", first_of_run).withColumn("_asked", asked).where("_kind = 'r' and _first and _asked is not null").withColumn("latency", F.col("ms") - F.col("_asked"))
    shake = s.where("syn").groupBy("flow_id", "client", "server").agg((F.min(F.when(F.col("ack") & ~F.col("from_client"), F.col("ms"))) - F.min(F.when(~F.col("ack") & F.col("from_client"), F.col("ms")))).alias("network"))
    rtt = shake.groupBy("client", "server").agg(F.avg("network").alias("network_ms"))
    out = calls.groupBy("client", "server").agg(F.count("*").alias("calls"), F.median("latency").alias("median_ms"), F.max("latency").alias("max_ms"))
    return out.join(rtt, ["client", "server"], "left")


def traces(spans: DataFrame) -> DataFrame:
    """Spans with offset in their trace, duration (null without a response) and depth by the parents that are present (roots 0). spans:
    trace_id, span_id, parent_id, start_ms, end_ms. Depths double their reach each round until all have met a root; spans that are their own
    ancestors are an error."""
    w = Window.partitionBy("trace_id")
    out = spans.withColumns({"offset_ms": F.col("start_ms") - F.min("start_ms").over(w), "duration_ms": F.col("end_ms") - F.col("start_ms"), "total_ms": F.max(F.coalesce("end_ms", "start_ms")).over(w) - F.min("start_ms").over(w)})
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct().withColumn("_known", F.lit(True))
    hop = spans.select("trace_id", "span_id", "parent_id").distinct().join(ids, ["trace_id", "parent_id"], "left").select("trace_id", "span_id", F.when(F.col("_known"), F.col("parent_id")).alias("up"), F.coalesce("_known", F.lit(False)).cast("long").alias("depth"))
    hop = settled(hop, "hops")
    deepest, reach, longest = hop.where("up is not null").count(), 1, None
    while deepest:
        if reach > 2 * (longest := longest or hop.count()):
            raise ValueError("spans are their own ancestors")
        nxt = hop.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up2"), F.col("depth").alias("_d2"))
        hop = settled(hop.join(nxt, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("_up2").alias("up"), (F.col("depth") + F.coalesce("_d2", F.lit(0))).alias("depth")), "hops")
        deepest, reach = hop.where("up is not null").count(), reach * 2
    return out.join(hop.select("trace_id", "span_id", "depth"), ["trace_id", "span_id"])


def trace_headers(text: Column) -> Column:
    """struct(trace_id, span_id) of a W3C traceparent or B3 header (single or multi); zero ids and version ff are refused."""
    get = lambda p, i: F.nullif(F.lower(F.regexp_extract(text, p, i)), F.lit(""))
    w3c = r"(?i)traceparent:\s*(?!ff)[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}"
    b3 = r"(?i)(?:^|\n)b3:\s*([0-9a-f]{32}|[0-9a-f]{16})-([0-9a-f]{16})"
    trace = F.coalesce(get(w3c, 1), get(b3, 1), get(r"(?i)x-b3-traceid:\s*([0-9a-f]{32}|[0-9a-f]{16})", 1))
    span = F.coalesce(get(w3c, 2), get(b3, 2), get(r"(?i)x-b3-spanid:\s*([0-9a-f]{16})", 1))
    return F.when(~trace.rlike("^0+$") & ~span.rlike("^0+$"), F.struct(trace.alias("trace_id"), span.alias("span_id")))


# First bytes of file kinds, in hex; bytes that end a file, and how many more belong to it.
MAGICS = (("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "474946383961"), ("pdf", "255044462D"), ("zip", "504B0304"), ("elf", "7F454C46"))
ENDS = (("jpeg", "FFD9", 0), ("png", "49454E44", 4))
#: Bytes of a file at most; more is taken for a false start.
FILE_BYTES = 5_000_000
LONGEST = max(len(m) // 2 for _, m in MAGICS)


def marks(pieces: DataFrame, kinds: tuple[tuple[str, str], ...]) -> DataFrame:
    """(flow columns, kind, offset): all places in the pieces of streams where the bytes of a kind stand, overlapping ones too."""
    flow = [c for c in pieces.columns if c not in ("begin", "data", "limit")]
    patterns = [(kind, re.compile(b"(?=" + re.escape(bytes.fromhex(magic)) + b")")) for kind, magic in kinds]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, places = [], [], []
            begins, limits = batch.column(batch.schema.get_field_index("begin")).to_pylist(), batch.column(batch.schema.get_field_index("limit")).to_pylist()
            for i, value in enumerate(batch.column(batch.schema.get_field_index("data"))):
                raw = value.as_py()
                for kind, pattern in patterns if raw else ():
                    at = [m.start() for m in pattern.finditer(raw) if m.start() < limits[i]]
                    rows += [i] * len(at)
                    names += [kind] * len(at)
                    places += [begins[i] + x for x in at]
            kept = batch.select(flow).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(places, pa.int64())], names=[*flow, "kind", "offset"])

    return pieces.mapInArrow(find, StructType([*(pieces.schema[c] for c in flow), StructField("kind", StringType()), StructField("offset", LongType())]))


def magic_census(streams: DataFrame, data: str = "data") -> DataFrame:
    """(stream columns, file_kind, file_offset): all places where the first bytes of known kinds of file stand in a value."""
    whole = streams.select(*(F.col(f"`{c}`") for c in streams.columns if c != data), F.lit(0).cast("long").alias("begin"), F.col(data).alias("data"), F.octet_length(data).alias("limit"))
    return marks(whole, MAGICS).withColumnsRenamed({"kind": "file_kind", "offset": "file_offset"})


def carve(segments: DataFrame, flow: list[str], piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(flow, file_kind, file_offset, file_size): the files in reassembled streams, from segments (flow, offset, data) as stream_segments gives
    them. Every place of every kind is found, also where packets cut it. JPEG and PNG files end at the first end mark after their start, else
    with the stream; a file of more than 5 MB is no file, and what stands inside of one is not looked at. Other kinds have no size."""
    cut = stream_pieces(segments, flow, LONGEST - 1, piece_bytes).withColumn("limit", F.lit(piece_bytes))
    found = marks(cut, (*MAGICS, *((f"{kind} end", mark) for kind, mark, _ in ENDS)))
    lengths = segments.groupBy(*flow).agg(F.max(F.col("offset") + F.octet_length("data")).alias("_length"))
    found = blocks.join_on(found, lengths, flow, ["_length"])
    size = F.lit(None).cast("long")
    for kind, _, more in ENDS:
        magic = len(dict(MAGICS)[kind]) // 2
        after = Window.partitionBy(*flow).orderBy("offset").rangeBetween(magic, Window.unboundedFollowing)
        end = F.min(F.when(F.col("kind") == f"{kind} end", F.col("offset"))).over(after)
        mark = len(next(m for k, m, _ in ENDS if k == kind)) // 2
        size = F.when(F.col("kind") == kind, F.coalesce(F.least(end + mark + more, F.col("_length")), F.col("_length")) - F.col("offset")).otherwise(size)
    files = found.withColumn("file_size", size).where(~F.col("kind").endswith(" end") & (F.col("file_size").isNull() | (F.col("file_size") <= FILE_BYTES)))
    files = files.withColumn("_covers", F.coalesce("file_size", F.lit(0)))

    def advance(free, offset, covers):
        return (free, False) if offset < (free or 0) else (offset + covers, True)

    kept = folds.fold(files, flow, ["offset", "kind"], ["offset", "_covers"], advance)
    return kept.select(*flow, F.col("kind").alias("file_kind"), F.col("offset").alias("file_offset"), "file_size")
