"""Per-minute counts of a stream of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.validation import BACKFILL, FUTURE

#: A record's time may trail the newest by the backfill and lead it by the clock skew.
LATE = "7 days 15 minutes"


def per_minute(records: DataFrame, now: Column | None = None) -> DataFrame:
    """(bucket, stream_id, level, n), updated until a minute is later than any accepted record can be.

    Records whose time would be refused are left out before the watermark, so none can move it past others.
    """
    moment = F.current_timestamp() if now is None else now
    step = lambda seconds: F.make_dt_interval(secs=F.lit(seconds))
    late = records.where(F.col("time").between(moment - step(BACKFILL), moment + step(FUTURE))).withWatermark("time", LATE)
    return late.groupBy(F.window("time", "60 seconds"), "stream_id", "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "stream_id", "level", "n")


