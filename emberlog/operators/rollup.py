"""Count rollups by minute and hour, and answering from a rollup that ends before the logs do."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.plans.compiler import bucket, floored, moment


def per_minute(logs: DataFrame) -> DataFrame:
    """(bucket, stream_id, level, n): records of each minute, stream and level."""
    return logs.groupBy(bucket(F.col("time"), 60).alias("bucket"), "stream_id", "level").agg(F.count("*").alias("n"))


def per_hour(minutes: DataFrame) -> DataFrame:
    """The same by the hour, from the minutes."""
    return minutes.groupBy(bucket(F.col("bucket"), 3600).alias("bucket"), "stream_id", "level").agg(F.sum("n").alias("n"))


def real_time(rollup: DataFrame, logs: DataFrame, watermark: datetime, seconds: int = 60) -> DataFrame:
    """The rollup before the watermark, floored to a bucket, and live counts of the logs from there on."""
    edge = floored(watermark, seconds)
    kind = rollup.schema["bucket"].dataType
    done = rollup.where(F.col("bucket") < moment(edge, kind))
    live = logs.where(F.col("time") >= moment(edge, logs.schema["time"].dataType))
    minutes = per_minute(live)
    return done.unionByName(minutes if seconds == 60 else per_hour(minutes))


def refreshed(rollup: DataFrame, logs: DataFrame, touched: DataFrame) -> DataFrame:
    """The rollup with the buckets of `touched` (bucket) counted anew from the logs; idempotent, however late a record is."""
    buckets = touched.select("bucket").distinct()
    again = logs.withColumn("bucket", bucket(F.col("time"), 60)).join(buckets, "bucket", "left_semi")
    counted = again.groupBy("bucket", "stream_id", "level").agg(F.count("*").alias("n"))
    return rollup.join(buckets, "bucket", "left_anti").unionByName(counted)
