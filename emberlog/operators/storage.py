"""The stored tables: first-writer-wins appends, the streams dimension, compaction, retention, statistics.

`logs` is Parquet partitioned by `event_date`, a date that only `time` decides, so a time range prunes
files and the duplicates of a batch can only be in the partitions that the batch touches.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators import files
from emberlog.plans.compiler import COLUMNS, day_of, moment, naive

KEY = ["stream_id", "seq", "time"]
RETENTION_DAYS, COMPACT_HOURS = 30, 2
#: Bytes of a compacted file.
FILE_BYTES = 128 << 20
#: How far the stored last_seen of a stream may lie behind.
REFRESH = timedelta(minutes=1)


def first_of_each(batch: DataFrame, arrival: Column | None = None) -> DataFrame:
    """The row of each key that came first: the one with the smallest `arrival`.

    Without an order, or where it is equal, the content decides: the smallest in an order of hashes, so that another attempt
    takes the same row.
    """
    rest = [c for c in batch.columns if c not in KEY]
    texts = [F.to_json(F.array_sort(F.map_entries(c))) if isinstance(batch.schema[c].dataType, T.MapType) else F.col(c).cast("string") for c in rest]
    order = F.struct(F.lit(0) if arrival is None else arrival, F.xxhash64(*texts) if texts else F.lit(0))
    return batch.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*(F.col(c) if c in KEY else F.col("_row")[c].alias(c) for c in batch.columns))


def new_rows(batch: DataFrame, stored: DataFrame | None, arrival: Column | None = None) -> DataFrame:
    """The rows of a batch whose key is neither stored nor repeated."""
    batch = first_of_each(batch, arrival)
    if stored is None:
        return batch
    if "event_date" in stored.columns:
        # the same partitions only, pruned at run time; accepted times span 7 days and 15 minutes, so these are nine rows at most
        days = batch.select(day_of(batch, "time").alias("event_date")).distinct()
        stored = stored.join(F.broadcast(days), "event_date", "left_semi")
    return batch.join(stored.select(*KEY), KEY, "left_anti")


def dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_date", day_of(rows, "time"))


def append_logs(rows: DataFrame, path: str) -> None:
    """Appends rows in the order that keeps a stream's records together."""
    out = dated(rows.select(*COLUMNS)).sortWithinPartitions("event_date", "stream_id", "seq", "time")
    out.write.mode("append").partitionBy("event_date").option("compression", "zstd").parquet(path)


def upserted(streams: DataFrame | None, seen: DataFrame) -> DataFrame:
    """The dimension with newly seen streams; first_seen is the earliest, last_seen never falls, labels don't change."""
    both = seen if streams is None else streams.unionByName(seen)
    pairs = F.array_sort(F.map_entries("labels"))
    keyed = both.select("stream_id", "service", "host", "env", pairs.alias("pairs"), "first_seen", "last_seen")
    out = keyed.groupBy("stream_id").agg(
        F.min("service").alias("service"), F.min("host").alias("host"), F.min("env").alias("env"), F.min("pairs").alias("pairs"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return out.select("stream_id", "service", "host", "env", F.map_from_entries("pairs").alias("labels"), "first_seen", "last_seen")


def streams_of(rows: DataFrame) -> DataFrame:
    """What a batch says about its streams."""
    pairs = F.array_sort(F.map_entries("labels"))
    out = rows.groupBy("stream_id", "service", "host", "env", pairs.alias("pairs")).agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    return out.select("stream_id", "service", "host", "env", F.map_from_entries("pairs").alias("labels"), "first_seen", "last_seen")


def fresh_streams(seen: DataFrame, stored: DataFrame | None, refresh: timedelta = REFRESH) -> DataFrame:
    """What a batch says of its streams that is worth storing: new ones, an earlier first_seen, a last_seen later by `refresh`.

    `stored` is `upserted` of all that was stored before.
    """
    if stored is None:
        return seen
    before = stored.select("stream_id", F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"))
    step = F.make_dt_interval(secs=F.lit(refresh.total_seconds()))
    new = F.col("_first").isNull() | (F.col("first_seen") < F.col("_first")) | (F.col("last_seen") >= F.col("_last") + step)
    return seen.join(before, "stream_id", "left").where(new).select(*seen.columns)


def retained(logs: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Records no older than the retention; rollups are never cut."""
    return logs.where(F.col("time") >= moment(naive(now) - timedelta(days=days), logs.schema["time"].dataType))


def drop_old_partitions(spark: SparkSession, path: str, now: datetime, days: int = RETENTION_DAYS) -> list[str]:
    """Deletes the date partitions that lie wholly before the retention; returns their dates."""
    edge = (naive(now) - timedelta(days=days)).date().isoformat()
    gone = [name for name in files.folders(spark, path) if name.startswith("event_date=") and name[11:] < edge]
    for name in gone:
        files.delete(spark, f"{path}/{name}")
    return [name[11:] for name in gone]


def compacted(logs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows segmented by stream, newest first: the layout that compresses and prunes best.

    Rows are dealt by ranges, so a stream that holds most of a day has several partitions.
    """
    order = ["event_date", "stream_id", F.desc("time"), "seq"]
    dealt = dated(logs)
    dealt = dealt.repartitionByRange(*order) if partitions is None else dealt.repartitionByRange(partitions, *order)
    return dealt.sortWithinPartitions(*order)


def compact(spark: SparkSession, path: str, now: datetime, hours: int = COMPACT_HOURS, make: Callable[[DataFrame, int], DataFrame] = compacted, stop: Callable[[str], None] = lambda _: None) -> list[str]:
    """Rewrites the date partitions that ended `hours` ago or more and have several files; returns their dates.

    What an attempt before left unfinished is finished first; see `files.replaced`.
    """
    edge = (naive(now) - timedelta(hours=hours)).date().isoformat()
    files.recover(spark, path)
    done = []
    for name in files.folders(spark, path):
        if not name.startswith("event_date=") or name[11:] >= edge:
            continue
        held = files.parts(spark, f"{path}/{name}")
        if len(held) < 2:
            continue
        count = -(-sum(held.values()) // FILE_BYTES)
        if len(held) <= count:
            continue
        files.replaced(spark, path, name, lambda day, n=count: make(day, n).drop("event_date"), stop)
        done.append(name[11:])
    return done


def summed(rates: DataFrame, partitions: int) -> DataFrame:
    """One row for each bucket, stream and level, for the compaction of rollups."""
    total = rates.groupBy("bucket", "stream_id", "level").agg(F.sum("n").alias("n")).where("n <> 0")
    return total.repartitionByRange(partitions, "bucket", "stream_id").sortWithinPartitions("bucket", "stream_id")


def size_of(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def statistics(spark: SparkSession, path: str) -> dict[str, float]:
    """Bytes of the records as text and numbers, bytes of the files, and their ratio (0 for no files)."""
    raw = spark.read.parquet(path).agg(F.sum(raw_bytes())).first()[0] or 0
    stored = size_of(spark, path)
    return {"raw_bytes": float(raw), "stored_bytes": float(stored), "ratio": raw / stored if stored and raw else 0.0}


def raw_bytes() -> Column:
    """Bytes of a record: numbers and times of eight bytes, a level of two, and texts."""
    return 8 + 8 + 8 + 2 + F.octet_length("message") + F.coalesce(F.octet_length(F.to_json("fields")), F.lit(0))
