"""Live tails: a selector and line filters on a stream of records with labels."""

from __future__ import annotations

import queue
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.extract import all_labels
from emberlog.plans.ast import Query
from emberlog.plans.compiler import tail_predicates
from emberlog.plans.parser import parse

BUFFER = 1024


def tailed(query: Query | str, records: DataFrame) -> DataFrame:
    """The records (batch or stream) that a tail shows, with all labels in one map; QueryError for stages it can't have."""
    query = parse(query) if isinstance(query, str) else query
    on_streams, on_records = tail_predicates(query)
    kept = records.where(on_streams & on_records)
    return kept.withColumn("all_labels", all_labels(F.col("service"), F.col("host"), F.col("env"), F.col("labels")))


class Subscriber:
    """A bounded buffer between the stream and a reader.  A slow reader loses records, which are counted; it never blocks the stream."""

    def __init__(self, size: int = BUFFER) -> None:
        self.queue: queue.Queue = queue.Queue(size)
        self.dropped = 0
        self._told = 0

    def take(self, timeout: float | None = None) -> tuple[object, int] | None:
        """The next record, and how many were lost since the one before; None if none came in time."""
        try:
            record = self.queue.get(timeout=timeout)
        except queue.Empty:
            return None
        lost, self._told = self.dropped - self._told, self.dropped
        return record, lost

    def offer(self, record: object) -> None:
        try:
            self.queue.put_nowait(record)
        except queue.Full:
            self.dropped += 1

    def drain(self) -> list:
        out = []
        while True:
            try:
                out.append(self.queue.get_nowait())
            except queue.Empty:
                return out


def offered(batch: DataFrame, subscriber: Subscriber) -> None:
    """Hands a batch of matching records to a subscriber, in order."""
    # no more than the buffer holds can be shown; the rest is only counted
    room = subscriber.queue.maxsize - subscriber.queue.qsize()
    rows = batch.orderBy("time", "seq").limit(room + 1).collect() if room > 0 else []
    for row in rows[:room]:
        subscriber.offer(row)
    if len(rows) > room or room <= 0:
        subscriber.dropped += batch.count() - min(len(rows), max(room, 0))


class Hub:
    """The tails of an ingest: what a batch accepts goes to all subscribers whose query it matches, and never waits for one."""

    def __init__(self) -> None:
        self._tails: dict[Subscriber, Query] = {}

    def subscribe(self, query: Query | str, size: int = BUFFER) -> Subscriber:
        """QueryError for what a tail can't have."""
        query = parse(query) if isinstance(query, str) else query
        tail_predicates(query)
        subscriber = Subscriber(size)
        self._tails[subscriber] = query
        return subscriber

    def leave(self, subscriber: Subscriber) -> None:
        self._tails.pop(subscriber, None)

    def publish(self, accepted: DataFrame) -> None:
        for subscriber, query in list(self._tails.items()):
            offered(tailed(query, accepted), subscriber)


def start(query: Query | str, records: DataFrame, subscriber: Subscriber, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Sends what a tail shows to the subscriber, newest batches as they come."""
    matching = tailed(query, records)

    def send(batch: DataFrame, _: int) -> None:
        offered(batch, subscriber)

    writer = matching.writeStream.foreachBatch(_kept(send))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _kept(send: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            send(batch, number)
        finally:
            batch.unpersist()

    return run
