"""Readers and the documented views under which the star tables stand for telemetry."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-vigil-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a new folder and read again: lost executors don't compute them anew, and later reads agree."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: a run for each day, a service for ten users, the event type as metric; clicks count as errors' carrier."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service_name"),
        F.col("event_type").alias("metric_name"), ts.alias("ts_us"), F.col("event_id").alias("event_id"), F.col("value").alias("numeric_value"), F.col("user_id").alias("series"),
    )


#: The same view for DuckDB.
OBS_SQL = """obs AS (SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, 'svc-' || (user_id % 10) AS service_name, event_type AS metric_name,
  epoch_us(ts) AS ts_us, event_id, value AS numeric_value, user_id AS series FROM events)"""
