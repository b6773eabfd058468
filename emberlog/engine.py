"""The façade: queries as text in, results out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators import discovery, report
from emberlog.operators.storage import REFRESH
from emberlog.plans.ast import Query, QueryError
from emberlog.plans.compiler import Catalog, Request, compile_query, matched_streams, naive
from emberlog.plans.parser import parse
from emberlog.streaming import tail

DEFAULT_LIMIT, MOST_ROWS, DEFAULT_RANGE = 1000, 5000, timedelta(hours=1)
MAX_QUERY_BYTES, MAX_BODY_BYTES = 8 << 10, 64 << 10
#: The first window in which records are looked for, and by how much the next one is wider.
WINDOW, GROWTH = timedelta(minutes=1), 16


@dataclass
class Result:
    """Records or points, and how they came about."""

    df: DataFrame
    source: str
    start: datetime
    end: datetime
    records: list[dict] | None = None
    points: list[dict] | None = None
    truncated: bool = False
    streams: int = 0
    warnings: list[str] = field(default_factory=list)
    elapsed: float = 0.0

    def as_dict(self) -> dict:
        rows = {k: v for k, v in (("records", self.records), ("points", self.points)) if v is not None}
        rest = {"source": self.source, "start": _utc(self.start), "end": _utc(self.end), "streams": self.streams, "truncated": self.truncated, "warnings": self.warnings, "elapsed_ms": round(self.elapsed * 1000, 3)}
        return rows | rest


def _utc(t: datetime) -> str:
    return t.isoformat() + ("Z" if t.tzinfo is None else "")


class Engine:
    """Queries a catalog.  Only results within the limit come to the driver."""

    def __init__(self, catalog: Catalog, max_rows: int = MOST_ROWS) -> None:
        self.catalog, self.max_rows = catalog, max_rows

    def request(self, start: datetime | None, end: datetime | None, limit: int | None, direction: str) -> Request:
        if direction not in ("backward", "forward"):
            raise QueryError(None, f'direction must be "forward" or "backward", got "{direction}"')
        end = end or datetime.now(UTC)
        start = start or end - DEFAULT_RANGE
        if start >= end:
            raise QueryError(None, "start must be before end")
        limit = DEFAULT_LIMIT if not limit else limit
        if limit < 0:
            raise QueryError(None, "limit must be positive")
        return Request(start, end, min(limit, self.max_rows), direction == "forward")

    def newest(self, query: Query, request: Request, streams: DataFrame) -> tuple[int, list[Row]]:
        """How many streams match, and the first records in the order asked for.

        Time is walked from the end where they begin, in windows that grow by `GROWTH`, until there are enough:
        a frequent match reads the last files only, a rare one reads every window once.  What is
        known of the streams bounds the walk.
        """
        seen = {"first_seen", "last_seen"} <= set(streams.columns)
        bounds = (micros(streams, "first_seen", F.min), micros(streams, "last_seen", F.max)) if seen else (F.lit(None), F.lit(None))
        count, first, last = streams.agg(F.count("*"), *bounds).first()
        start, end = naive(request.start), naive(request.end)
        if first is not None:  # a stored last_seen may lie behind
            epoch = datetime(1970, 1, 1)
            start, end = max(start, epoch + timedelta(microseconds=first)), min(end, epoch + timedelta(microseconds=last + 1) + REFRESH)
        out: list[Row] = []
        width = WINDOW
        while count and start < end and len(out) < request.limit:
            low, high = (start, min(end, start + width)) if request.forward else (max(start, end - width), end)
            part = Request(low, high, request.limit - len(out), request.forward)
            out += report.rendered(compile_query(query, part, self.catalog).df).collect()  # the limit's rows at most
            start, end, width = (high, end, width * GROWTH) if request.forward else (start, low, width * GROWTH)
        return count, out

    def query(self, text: str, start: datetime | None = None, end: datetime | None = None, limit: int | None = None, direction: str = "backward") -> Result:
        """Runs a query; one row more than the limit tells whether there are others."""
        began = time.monotonic()
        if len(text.encode()) > MAX_QUERY_BYTES:
            raise QueryError(None, f"query is {len(text.encode())} bytes, max {MAX_QUERY_BYTES}")
        query = parse(text)
        request = self.request(start, end, limit, direction)
        more = Request(request.start, request.end, request.limit + 1, request.forward)
        plan = compile_query(query, more, self.catalog)
        out = Result(plan.df, plan.source, plan.start, plan.end)
        streams = matched_streams(query, self.catalog.streams)
        if query.agg is None:
            out.streams, rows = self.newest(query, more, streams)
        else:
            out.streams = streams.count()
            rows = plan.df.limit(request.limit + 1).collect() if out.streams else []
        if not out.streams:  # the logs are not read
            out.records = out.points = []
            return out
        got = [r.asDict(recursive=True) for r in rows]
        out.truncated, got = len(got) > request.limit, got[: request.limit]
        if query.agg is None:
            out.records = [{k: v for k, v in r.items() if v is not None} for r in got]
        else:
            # a missing group value has no key
            out.points = [{"bucket": r["bucket"], "value": r["value"], "by": {k: _named(k, r[k]) for k in query.agg.by if r[k] is not None}} for r in got]
        out.elapsed = time.monotonic() - began
        return out

    def labels(self) -> list[str]:
        return [r.name for r in discovery.label_names(self.catalog.streams).collect()]

    def label_values(self, name: str) -> list[str]:
        return [r.value for r in discovery.label_values(self.catalog.streams, name).collect()]

    def tail(self, text: str, records: DataFrame) -> DataFrame:
        return tail.tailed(text, records)

    def handle(self, body: dict | str | bytes) -> dict:
        """A request, {query, start, end, limit, direction} as a dict or as JSON text of 64 KiB at most, to its answer as a dict."""
        if not isinstance(body, dict):
            raw = body.encode() if isinstance(body, str) else body
            if len(raw) > MAX_BODY_BYTES:
                raise QueryError(None, f"request is {len(raw)} bytes, max {MAX_BODY_BYTES}")
            body = json.loads(raw)
            if not isinstance(body, dict) or not isinstance(body.get("query"), str):
                raise QueryError(None, "request must be an object with a query")
        parsed = {k: datetime.fromisoformat(body[k]) if body.get(k) else None for k in ("start", "end")}
        return self.query(body["query"], parsed["start"], parsed["end"], body.get("limit"), body.get("direction", "backward")).as_dict()


def micros(df: DataFrame, column: str, of: Callable[[Column], Column]) -> Column:
    """An aggregate of a time as microseconds since 1970 in UTC."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), of(F.col(column)))
    return F.unix_micros(of(F.col(column)))


def _named(key: str, value: object) -> object:
    from emberlog.plans.levels import NAMES

    return NAMES[value] if key == "level" and isinstance(value, int) else value


def with_labels(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Records with the promoted labels of their streams."""
    return records.join(streams.select("stream_id", "service", "host", "env"), "stream_id").withColumn("level", F.col("level").cast("int"))
