"""Ingest: validate, name streams, drop duplicates, store, and keep the rollups right."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.fingerprint import with_stream_ids
from emberlog.functions.validation import label_reason, record_reason
from emberlog.operators import files, report, rollup, storage
from emberlog.plans.compiler import COLUMNS, Catalog, bucket, day_of, floored, in_range, naive
from emberlog.streaming.tail import Hub

EXTRA = ["service", "host", "env", "labels"]


@dataclass(frozen=True)
class Store:
    """Folders of the tables."""

    root: str

    @property
    def logs(self) -> str:
        return f"{self.root}/logs"

    @property
    def streams(self) -> str:
        return f"{self.root}/streams"

    @property
    def rejected(self) -> str:
        return f"{self.root}/rejected"

    @property
    def open(self) -> str:
        """The note of the minutes whose logs may be ahead of their rollups."""
        return f"{self.root}/_open.json"

    @property
    def minutes(self) -> str:
        """The counts of the batch at hand."""
        return f"{self.root}/_minutes"

    def rates(self, name: str) -> str:
        return f"{self.root}/{name}"


def judged(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with `reason`: why their labels or they themselves are refused, else null."""
    labels = label_reason(F.col("service"), F.col("host"), F.col("env"), F.col("labels"))
    return rows.withColumn("reason", F.coalesce(labels, record_reason(now)))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if files.exists(spark, path) else None


def streams_at(spark: SparkSession, store: Store) -> DataFrame | None:
    """The dimension: batches only add to it, so the rows of a stream are merged as they are read."""
    stored = _stored(spark, store.streams)
    return None if stored is None else storage.upserted(None, stored)


def write_batch(rows: DataFrame, store: Store, now: Column | datetime | None = None, stop: Callable[[str], None] = lambda _: None, tails: Hub | None = None) -> dict[str, object]:
    """One batch of records with labels: refused rows go to `rejected`, new ones to `logs`.

    Writing a batch again adds nothing: keys that are stored are dropped, and the rollups get the counts
    of the rows that are new.  All tables are only added to; rollups and streams are summed up as they are
    read.  Between the logs and their rollups a note tells which minutes are open; the batch that finds
    one counts these minutes anew first, so a stop at any point loses and doubles nothing.  A store has one
    writer.  What is accepted goes to the `tails` too.  Returns received, rejected, deduped and written rows, and
    `reasons`: rejected rows by reason.
    """
    spark = rows.sparkSession
    repaired(spark, store)
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(naive(now).isoformat() + "Z").cast("timestamp")
    rows = rows.withColumns({"time": F.date_trunc("microsecond", "time"), "arrival": F.monotonically_increasing_id()})
    rows = judged(rows, moment).persist()
    try:
        counts = {r["reason"]: r["n"] for r in report.outcome_counts(rows).collect()}  # a row for each reason there is
        written = 0
        received, accepted = sum(counts.values()), counts.pop("accepted", 0)
        if accepted < received:
            rows.where(F.col("reason").isNotNull()).drop("arrival").write.mode("append").parquet(store.rejected)
        if accepted:
            if tails is not None:
                tails.publish(rows.where(F.col("reason").isNull()).drop("reason", "arrival"))
            written = _accept(rows.where(F.col("reason").isNull()).drop("reason"), store, stop)
        return {"received": received, "rejected": received - accepted, "deduped": accepted - written, "written": written, "reasons": counts}
    finally:
        rows.unpersist()


def _accept(rows: DataFrame, store: Store, stop: Callable[[str], None]) -> int:
    spark = rows.sparkSession
    good = with_stream_ids(rows).withColumn("fields", F.when(F.size("fields") > 0, F.col("fields")))
    # streams first, so no record is without its stream
    streams = storage.fresh_streams(storage.streams_of(good), streams_at(spark, store)).persist()
    if not streams.isEmpty():
        streams.write.mode("append").parquet(store.streams)
    streams.unpersist()
    stop("streams")
    fresh = storage.new_rows(good.select(*COLUMNS, "arrival"), _stored(spark, store.logs), F.col("arrival")).drop("arrival").persist()
    try:
        # kept beside the tables: a write to the logs makes Spark compute what is cached of them anew
        rollup.per_minute(fresh).write.mode("overwrite").parquet(store.minutes)
        minutes = spark.read.parquet(store.minutes)
        n, low, high = minutes.agg(F.sum("n"), F.unix_seconds(F.min("bucket")), F.unix_seconds(F.max("bucket"))).first()
        if n:
            files.put_text(spark, store.open, json.dumps([low, high]))
            stop("noted")
            storage.append_logs(fresh, store.logs)
            stop("logs")
            _add(minutes, store.rates("logs_rate_1m"))
            stop("minutes")
            _add(rollup.per_hour(minutes), store.rates("logs_rate_1h"))
            files.delete(spark, store.open)
        return n or 0
    finally:
        fresh.unpersist()


def _add(counted: DataFrame, path: str) -> None:
    out = counted.select("bucket", "stream_id", "level", "n", day_of(counted, "bucket").alias("event_date"))
    out.write.mode("append").partitionBy("event_date").parquet(path)


def repaired(spark: SparkSession, store: Store) -> None:
    """Finishes what a stop left open: the rollups of the noted minutes get what they lack (or have too much) against the logs."""
    note = files.get_text(spark, store.open)
    if note is None:
        return
    low, high = json.loads(note)
    if files.exists(spark, store.logs):
        for name, width in (("logs_rate_1m", 60), ("logs_rate_1h", 3600)):
            first, last = (floored(datetime.fromtimestamp(t, UTC), width) for t in (low, high))
            last += timedelta(seconds=width)
            logs = in_range(spark.read.parquet(store.logs), first, last, "time", "event_date")
            due = rollup.per_minute(logs) if width == 60 else rollup.per_hour(rollup.per_minute(logs))
            have = _stored(spark, store.rates(name))
            if have is not None:
                had = in_range(have, first, last, "bucket", "event_date").select("bucket", "stream_id", "level", (-F.col("n")).alias("n"))
                due = due.select("bucket", "stream_id", "level", "n").unionByName(had).groupBy("bucket", "stream_id", "level").agg(F.sum("n").alias("n")).where("n <> 0")
            _add(due, store.rates(name))
    files.delete(spark, store.open)


def compact(spark: SparkSession, store: Store, now: datetime, hours: int = storage.COMPACT_HOURS) -> dict[str, list[str]]:
    """Compacts the logs and the rollups of days that are over, and the streams; returns the days by table."""
    repaired(spark, store)
    done = {"logs": storage.compact(spark, store.logs, now, hours)}
    for name in ("logs_rate_1m", "logs_rate_1h"):
        done[name] = storage.compact(spark, store.rates(name), now, hours, storage.summed)
    files.recover(spark, store.streams)
    if len(files.parts(spark, store.streams)) > 1:
        files.replaced(spark, store.streams, "", lambda rows: storage.upserted(None, rows))
    return done


def start(rows: DataFrame, store: Store, checkpoint: str, now: Column | datetime | None = None, once: bool = False, tails: Hub | None = None, told: Callable[[dict], None] | None = None) -> StreamingQuery:
    """A stream of records with labels into the store.

    Duplicates go by the key that is stored.  There is no watermark: times are judged batch by batch, so
    one that is refused drops no other record, and late records reach `rejected`.  Delivery is at least
    once, storage is exactly once.  `told` gets the result of each batch, see `report.Counters`.
    """

    def batch(df: DataFrame, _: int) -> None:
        done = write_batch(df.drop("pairs"), store, now, tails=tails)
        if told is not None:
            told(done)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the labels as sorted pairs, which state can be keyed by (maps can't); `start` takes rows with or without them."""
    return rows.withColumn("pairs", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))))


def catalog(spark: SparkSession, store: Store) -> Catalog:
    """The stored tables, ready to query."""
    rates = {n: spark.read.parquet(store.rates(n)) for n in ("logs_rate_1m", "logs_rate_1h")}
    return Catalog(streams_at(spark, store), spark.read.parquet(store.logs), rates, "event_date")
