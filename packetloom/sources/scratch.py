"""Folders for what a query writes on its way: under spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; it is removed when the application ends. Unset, a local run (tests) sets a
    temporary one and a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        else:
            base = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/packetloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder: what is read again is not computed again, and a lost executor costs no more than
    the tasks that read it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
