"""Text and JSON inputs and outputs: event batches, indicator lists, lines for logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks

EVENT_SCHEMA = "event_type string, severity string, title string, source_ip string, dest_ip string, protocol string, port int, sensor_id string, timestamp string"


def parse_events(lines: DataFrame, column: str, received_us: int, sensors: DataFrame | None = None) -> DataFrame:
    """A JSON array per row becomes events: a bad or missing time becomes the time of receipt, an unknown sensor null."""
    events = lines.select(F.explode(F.from_json(column, f"array<struct<{EVENT_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("e")).select("e.*")
    when = F.coalesce(F.try_to_timestamp(F.col("timestamp")), F.timestamp_micros(F.lit(received_us)))
    out = events.withColumn("us", F.unix_micros(when)).drop("timestamp")
    if sensors is None:
        return out
    known = sensors.select("sensor_id").distinct().withColumn("_known", F.lit(True))
    return out.join(known, "sensor_id", "left").withColumn("sensor_id", F.when(F.col("_known"), F.col("sensor_id"))).drop("_known")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", True).json(path)


def parse_indicators(lines: DataFrame, column: str = "value") -> DataFrame:
    """One value per line; blank lines and # comments go, names in lower case, each value once."""
    text = F.lower(F.trim(F.regexp_replace(column, "#.*$", "")))
    return lines.select(text.alias("value")).where("value <> ''").distinct()


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    return parse_indicators(spark.read.text(path))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def csv_line(*columns: Column) -> Column:
    """Quoted fields, quotes doubled, null as empty."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))


def write_rotated(rows: DataFrame, path: str, records: int, hour: Column) -> None:
    """Parquet by hour, files of at most so many rows."""
    rows.withColumn("hour_bucket", hour).write.mode("append").option("maxRecordsPerFile", records).partitionBy("hour_bucket").parquet(path)


def write_by_bytes(lines: DataFrame, path: str, order: list[str], limit: int, newest: int | None = None, block_rows: int = blocks.BLOCK_ROWS) -> None:
    """Text files of lines (column value) in the order, each named by a rising number (file=n) and of `limit` bytes, give or take a line.

    A line belongs to the file in which the bytes before it fall, so that files are cut where a single writer would cut them, and are
    written by as many tasks. Numbers go on from those in the folder. With newest, only so many files stay: older ones are removed, and those
    of this call that would be are not written."""
    spark = lines.sparkSession
    there = _numbers(spark, path)
    first = max(there, default=-1) + 1
    sized = blocks.preceding(lines, [], order, F.octet_length("value") + 1, "before", block_rows)
    numbered = sized.withColumn("file", F.floor(F.col("before") / limit) + first)
    if newest is not None:
        last = numbered.agg(F.max("file")).first()[0]
        if last is not None:
            numbered = numbered.where(F.col("file") > last - newest)
            _remove(spark, path, [n for n in there if n <= last - newest])
    numbered.repartition("file").sortWithinPartitions("file", *order).select("value", "file").write.mode("append").partitionBy("file").text(path)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of files that stand in a folder, by a listing of its names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
    return [int(n.removeprefix("file=")) for n in names if n.startswith("file=")]


def _remove(spark: SparkSession, path: str, numbers: list[int]) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for n in numbers:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/file={n}"), True)


def export_batches(stream: DataFrame, paths: list[str], checkpoint: str):
    """A streaming query that writes each batch to every target, under the number of the batch: a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        for path in paths:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_lines(rows: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Prometheus text: name{label="value",...} number."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels))
    return rows.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))


def numbered_report(rows: DataFrame, order: list[str], buckets: str) -> DataFrame:
    """Rows numbered from 1 in the order, whose first column is that of `buckets`: counts per bucket give each bucket its start, so that no
    task numbers all rows."""
    starts = rows.groupBy(buckets).agg(F.count("*").alias("_n")).selectExpr(buckets, f"sum(_n) over (order by {buckets}) - _n as _start")
    return rows.join(starts, buckets).selectExpr("*", f"_start + row_number() over (partition by {buckets} order by {', '.join(order)}) as number").drop("_start")
