"""Text sources: splitting lines, container timestamps, service names, routing tokens."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.ingest_fields import extracted
from emberlog.functions.validation import MESSAGE
from emberlog.plans import levels
from emberlog.sources.follow import FollowSource

LINE = T.StructType([T.StructField("source", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("line", T.StringType())])


def assembled(line: Column, most: int = MESSAGE) -> Column:
    """A line without one carriage return at its end, cut to so many bytes at a whole character."""
    line = F.regexp_replace(line, "\\r\\z", "")
    raw = F.encode(line, "UTF-8")
    # a cut inside a character decodes to a replacement character, which goes
    short = F.regexp_replace(F.decode(F.substring(raw, 1, most), "UTF-8"), "\\x{FFFD}+\\z", "")
    return F.when(F.octet_length(line) > most, short).otherwise(line)


def container_split(line: Column) -> tuple[Column, Column]:
    """Time and message of `<RFC 3339 time> <message>`; a null time and the whole line where there is no such time."""
    head = F.substring_index(line, " ", 1)
    shape = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"
    # storage keeps microseconds
    time = F.when(line.contains(" ") & head.rlike(shape), F.regexp_replace(head, r"(\.\d{6})\d+", "$1").try_cast("timestamp"))
    rest = F.substring(line, F.length(head) + 2, F.length(line))
    return time, F.when(time.isNotNull(), rest).otherwise(line)


def service_of(path: Column) -> Column:
    """The service a file's name stands for: its last part without the extension."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*\z", "")


def container_service(name: Column, stream: Column) -> Column:
    return F.concat_ws("-", name, stream)


def routing_token(value: Column) -> Column:
    """A lossy token of [A-Za-z0-9_-]: bytes that are none become `_`, 64 bytes at most, `_` for the empty text."""
    latin = F.decode(F.substring(F.encode(value, "UTF-8"), 1, 64), "ISO-8859-1")
    token = F.regexp_replace(latin, "[^A-Za-z0-9_-]", "_")
    return F.when(token == "", "_").otherwise(token)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the bytes that each line takes by those of the lines before it in its split; splits follow one another."""
    split, done = None, 0
    for batch in batches:
        taken = np.asarray(batch.column(2))
        before = np.cumsum(taken) - taken
        block = np.asarray(batch.column(1))
        path = batch.column(0).dictionary_encode()
        code = np.asarray(path.indices)
        opens = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (code[1:] != code[:-1]))) if len(block) else []
        parts = []
        for first, last in zip(opens, [*opens[1:], len(block)], strict=True):
            here = (path.dictionary[int(code[first])].as_py(), int(block[first]))
            if here != split:
                split, done = here, 0
            parts.append(before[first:last] - before[first] + done)
            done += int(taken[first:last].sum())
        yield batch.set_column(2, "taken", pa.array(np.concatenate(parts) if parts else taken, pa.int64()))


def text_lines(spark: SparkSession, path: str, time: datetime | None = None) -> DataFrame:
    """(source, time, seq, line) of closed text files; a line feed ends a line.

    seq is the byte offset of the line in its file, so reading again gives the same rows however files
    are split and packed, and time is the file's modification time (or the one given), never the time of
    reading: replays are duplicates.  Files are read twice, once for the bytes that the lines of each split take.
    """
    rows = spark.read.format("text").option("lineSep", "\n").load(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        (F.octet_length("value") + 1).cast("long").alias("taken"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").cast("binary").alias("raw"),
    )
    # a few rows for each file: where the lines of each split begin
    splits = rows.groupBy("source", "block").agg(F.sum("taken").alias("all"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("source", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("begin"))
    placed = rows.mapInArrow(_placed, rows.schema).join(begins, ["source", "block"])
    return placed.select(
        "source",
        (F.lit(time).cast("timestamp") if time else F.col("modified")).alias("time"),
        (F.col("begin") + F.col("taken")).alias("seq"),
        assembled(F.col("raw").cast("string")).alias("line"),
    )


def stream_lines(spark: SparkSession, pattern: str, most: int | None = None) -> DataFrame:
    """(source, file, time, start, offset, line) of files that grow, are rotated or truncated, as a stream: see `follow`."""
    spark.dataSource.register(FollowSource)
    reader = spark.readStream.format("follow").option("path", pattern)
    return (reader if most is None else reader.option("most", most)).load()


def container_lines(rows: DataFrame, container: Column, stream: Column, raw: str = "line") -> DataFrame:
    """Lines of a container's output: time and seq (its nanoseconds) from the time in front, the message, and the service.

    A line without a time keeps its own (columns time and start).
    """
    stamp, message = container_split(F.col(raw))
    fraction = F.rpad(F.regexp_extract(F.substring_index(F.col(raw), " ", 1), r"\.(\d{1,9})", 1), 9, "0")
    nanos = F.unix_seconds(stamp) * 1_000_000_000 + F.coalesce(fraction.try_cast("long"), F.lit(0))
    return rows.withColumns({
        "time": F.coalesce(stamp, F.col("time")), "start": F.coalesce(nanos, F.col("start")), raw: message, "service": container_service(container, stream)
    })


EMPTY = "map()"


def records(
    rows: DataFrame, host: str, env: str, service: Column | None = None, use_json: bool = True, pattern: str | None = None,
    level_field: str = "level", service_field: str | None = None, labels: dict[str, str] | None = None, text: str = "line",
) -> DataFrame:
    """Lines (source, time, start, `text`) as records with labels, ready for `ingest.start` and `ingest.write_batch`.

    Fields come from JSON keys and the pattern's groups; the level is that of `level_field`, the service that of
    `service_field`, then `service`, then the file's name.  seq is the line's start.  A level or service that
    isn't there is unspecified or falls to the next one.
    """
    out = rows.withColumn("fields", extracted(F.col(text), use_json, pattern))
    named = [] if service_field is None else [F.nullif(F.element_at("fields", F.lit(service_field)), F.lit(""))]
    extra = F.create_map(*(F.lit(x) for pair in sorted((labels or {}).items()) for x in pair)) if labels else F.expr(EMPTY).cast("map<string,string>")
    return out.select(
        F.col("time").cast("timestamp").alias("time"), F.col("start").cast("long").alias("seq"), levels.number_column(F.element_at("fields", F.lit(level_field))).alias("level"),
        assembled(F.col(text)).alias("message"), F.coalesce(*named, *([] if service is None else [service]), service_of(F.col("source"))).alias("service"),
        F.lit(host).alias("host"), F.lit(env).alias("env"), extra.alias("labels"), F.lit(None).cast("binary").alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), "fields",
    )


def manual(spark: SparkSession, messages: list[str], service: str, host: str, env: str, level: str, time: datetime) -> DataFrame:
    """Records of one label set and level with seq from 0, as a person sends them by hand."""
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "seq long, message string")
    number = levels.number(level)
    if number is None:
        raise ValueError(f"unknown level {level!r}")
    return rows.select(
        F.lit(time).cast("timestamp").alias("time"), "seq", F.lit(number).cast("short").alias("level"), assembled(F.col("message")).alias("message"),
        F.lit(service).alias("service"), F.lit(host).alias("host"), F.lit(env).alias("env"), F.expr(EMPTY).cast("map<string,string>").alias("labels"),
        F.lit(None).cast("binary").alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), F.lit(None).cast("map<string,string>").alias("fields"),
    )
