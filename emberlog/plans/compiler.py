"""Queries to lazy DataFrames.

No SQL text is built: values of users are literals of Column expressions.  The same predicates serve
batch tables and streams.  Streams are filtered first and met by a semi-join; a full join happens only
where a stage or a grouping reads a promoted label; aggregations that only count rows of whole streams
read a rollup instead of the logs.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.extract import Extractor, compared, from_fields, from_json, from_logfmt, from_regexp, number_compared
from emberlog.plans import levels
from emberlog.plans.ast import Aggregation, LabelFilter, LineFilter, Matcher, ParserStage, Query, QueryError
from emberlog.plans.parser import parse
from emberlog.plans.regexes import translate

PROMOTED = ("service", "host", "env")
COLUMNS = ["time", "stream_id", "seq", "level", "message", "trace_id", "span_id", "fields"]
ORIGIN = datetime(2000, 1, 3)
#: Rollups by falling width: seconds and their table.
GRAINS = ((3600, "logs_rate_1h"), (60, "logs_rate_1m"))


@dataclass
class Catalog:
    """The tables: `streams`, `logs`, and rollups by name.  `partition` is a date column of `logs` derived from `time`."""

    streams: DataFrame
    logs: DataFrame
    rollups: dict[str, DataFrame] | None = None
    partition: str | None = None


@dataclass(frozen=True)
class Request:
    """Half-open time range; times are UTC, with or without zone.  No limit gives all rows.

    A side that is None is open; with both open, rows without a time belong to the range too.
    """

    start: datetime | None
    end: datetime | None
    limit: int | None = 1000
    forward: bool = False


@dataclass(frozen=True)
class Plan:
    df: DataFrame
    source: str
    start: datetime | None
    end: datetime | None


def naive(t: datetime) -> datetime:
    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def moment(t: datetime, kind: T.DataType) -> Column:
    """A literal of the type of the time column it is compared with."""
    text = naive(t).isoformat(" ", "microseconds")
    return F.lit(text).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.lit(text + "Z").cast("timestamp")


def day_of(df: DataFrame, column: str) -> Column:
    """The date of a time in UTC, whatever the session's zone is."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.to_date(column)
    return F.date_from_unix_date(F.floor(F.unix_seconds(column) / 86400).cast("int"))


def floored(t: datetime, seconds: int) -> datetime:
    """The start of the bucket of `seconds` that holds t; buckets count from ORIGIN in both directions."""
    return ORIGIN + (naive(t) - ORIGIN) // timedelta(seconds=seconds) * timedelta(seconds=seconds)


def widened(start: datetime | None, end: datetime | None, seconds: int) -> tuple[datetime | None, datetime | None]:
    low, high = (t and floored(t, seconds) for t in (start, end))
    return low, high if end is None or high == naive(end) else high + timedelta(seconds=seconds)


def bucket(time: Column, seconds: int) -> Column:
    offset = int((ORIGIN - datetime(1970, 1, 1)).total_seconds()) % seconds
    return F.window(time, f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds")["start"]


def source_of(query: Query) -> str:
    """The coarsest table that answers the query; rollups only where that is provably the same."""
    agg = query.agg
    if agg is None or query.stages or agg.func == "bytes_over_time" or any(x not in (*PROMOTED, "level") for x in agg.by):
        return "logs"
    return next((name for width, name in GRAINS if agg.seconds % width == 0), "logs")


def stream_predicate(m: Matcher) -> Column:
    """A selector matcher on a stream's labels; a missing extra label is the empty text, but `=` needs the label."""
    if m.label in PROMOTED:
        value = F.col(m.label)
    elif m.op == "=":
        return F.element_at("labels", F.lit(m.label)) == F.lit(m.value)
    else:
        value = F.coalesce(F.element_at("labels", F.lit(m.label)), F.lit(""))
    return text_predicate(value, m.op, m.value)


def text_predicate(value: Column, op: str, wanted: str) -> Column:
    if op in ("=~", "!~"):
        hit = value.rlike(translate(wanted).whole())
        return ~hit if op == "!~" else hit
    return compared(value, op, F.lit(wanted))


def level_predicate(op: str, name: str) -> Column:
    return compared(F.col("level"), op, F.lit(levels.number(name)).cast("short"))


def line_predicate(f: LineFilter) -> Column:
    message = F.col("message")
    if f.op in ("|~", "!~"):
        hit = message.rlike(translate(f.text).search())
    else:
        hit = F.contains(F.lower(message), F.lower(F.lit(f.text)))
    return ~hit if f.op[0] == "!" else hit


def stream_matchers(query: Query) -> list[Matcher]:
    return [m for m in query.matchers if m.label != "level"]


def matched_streams(query: Query, streams: DataFrame) -> DataFrame:
    for m in stream_matchers(query):
        streams = streams.where(stream_predicate(m))
    return streams


def record_predicates(query: Query) -> tuple[list[Column], Extractor, bool]:
    """Predicates on records in order, the extractor in force at the end, and whether promoted labels are read."""
    out = [level_predicate(m.op, m.value) for m in query.matchers if m.label == "level"]
    extract, promoted = from_fields(F.col("fields")), False
    for stage in query.stages:
        if isinstance(stage, LineFilter):
            out.append(line_predicate(stage))
        elif isinstance(stage, ParserStage):
            message = F.col("message")
            extract = {"json": from_json, "logfmt": from_logfmt}[stage.kind](message) if stage.kind != "regexp" else from_regexp(message, stage.pattern)
        elif stage.label == "level":
            out.append(level_predicate(stage.op, stage.value))
        else:
            promoted |= stage.label in PROMOTED
            out.append(label_predicate(stage, extract))
    return out, extract, promoted


def label_value(name: str, extract: Extractor) -> Column:
    """level, then promoted labels (after a parser stage too), then the extractor in force."""
    if name in PROMOTED:
        return F.col(name)
    try:
        return extract(name)
    except KeyError:
        raise QueryError(None, f'label "{name}" is not a capture group of the regexp stage') from None


def label_predicate(f: LabelFilter, extract: Extractor) -> Column:
    value = label_value(f.label, extract)
    if f.numeric:
        return number_compared(value, f.op, f.value)
    return text_predicate(F.coalesce(value, F.lit("")), f.op, f.value)


def in_range(df: DataFrame, start: datetime | None, end: datetime | None, column: str, partition: str | None) -> DataFrame:
    kind = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= moment(start, kind))
    if end is not None:
        df = df.where(F.col(column) < moment(end, kind))
    if partition is not None:  # the same range on the partition column prunes files
        if start is not None:
            df = df.where(F.col(partition) >= F.lit(naive(start).date()))
        if end is not None:
            df = df.where(F.col(partition) <= F.lit((naive(end) - timedelta(microseconds=1)).date()))
    return df


def compile_query(query: Query | str, request: Request, catalog: Catalog) -> Plan:
    """The plan of a query: records (limit rows at most) or points (bucket, value, labels of `by`).

    Records have the columns of `COLUMNS`, in the order of time, seq and stream.  Points are ordered by
    bucket and then rising labels, nulls last.  A range is widened to whole buckets.
    """
    query = parse(query) if isinstance(query, str) else query
    agg = query.agg
    source = source_of(query) if catalog.rollups else "logs"
    if source != "logs" and source not in (catalog.rollups or {}):
        source = "logs"
    start, end = widened(request.start, request.end, agg.seconds) if agg else tuple(t and naive(t) for t in (request.start, request.end))
    time = "time" if source == "logs" else "bucket"
    table = catalog.logs if source == "logs" else catalog.rollups[source]
    rows = in_range(table, start, end, time, catalog.partition if catalog.partition in table.columns else None)

    predicates, extract, promoted = record_predicates(query)
    promoted |= bool(agg) and any(x in PROMOTED for x in agg.by)
    matchers = stream_matchers(query)
    streams = matched_streams(query, catalog.streams)
    if promoted:
        rows = rows.join(streams.select("stream_id", *PROMOTED), "stream_id")
    elif matchers:
        rows = rows.join(streams.select("stream_id"), "stream_id", "left_semi")
    for p in predicates:
        rows = rows.where(p)
    if agg is None:
        ways = [F.col(c).asc() if request.forward else F.col(c).desc() for c in ("time", "seq", "stream_id")]
        out = rows.select(*COLUMNS).orderBy(*ways)
        return Plan(out if request.limit is None else out.limit(request.limit), source, start, end)
    return Plan(aggregated(rows, agg, time, source, extract, request.forward), source, start, end)


def aggregated(rows: DataFrame, agg: Aggregation, time: str, source: str, extract: Extractor, forward: bool) -> DataFrame:
    keys = [F.col("level").alias("level") if name == "level" else label_value(name, extract).alias(name) for name in agg.by]
    number = F.count("*") if source == "logs" else F.sum("n")
    value = {
        "rate": number.cast("double") / F.lit(float(agg.seconds)),
        "count_over_time": number.cast("double"),
        "bytes_over_time": F.sum(F.octet_length("message")).cast("double"),
    }[agg.func]
    # a window alone would drop rows without a time, which are a bucket of their own
    at = F.coalesce(F.col(time), moment(ORIGIN, rows.schema[time].dataType))
    start = F.when(F.col(time).isNotNull(), bucket(at, agg.seconds))
    points = rows.groupBy(start.alias("bucket"), *keys).agg(value.alias("value"))
    first = F.col("bucket").asc() if forward else F.col("bucket").desc()
    return points.orderBy(first, *(F.col(name).asc_nulls_last() for name in agg.by))


def tail_predicates(query: Query) -> tuple[Column, Column]:
    """Of a live tail: the predicate on streams and that on records.  Only selectors and line filters are allowed."""
    for stage in query.stages:
        if isinstance(stage, LabelFilter):
            raise QueryError(stage.pos, f"tail supports selectors and line filters; label filter | {stage.label} needs query")
        if isinstance(stage, ParserStage):
            raise QueryError(stage.pos, f"tail supports selectors and line filters; | {stage.kind} needs query")
    if query.agg is not None:
        raise QueryError(query.agg.pos, "tail cannot aggregate; use query")
    on_streams, on_records = F.lit(True), F.lit(True)
    for m in stream_matchers(query):
        on_streams = on_streams & stream_predicate(m)
    for p in record_predicates(query)[0]:
        on_records = on_records & p
    return on_streams, on_records
