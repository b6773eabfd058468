"""Joining the lines of multi-line records in a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(lines: DataFrame, continues: Column, source: str = "source", order: str = "start", text: str = "line", chunk: int | None = None) -> DataFrame:
    """(source, start, last, lines, text): records of lines; a line that continues goes to the record before it.

    The first line of a source begins a record whatever it is.  A record keeps the order value of its
    first line, and of its last as `last`.  Text is joined by line feeds, in order.

    A source is worked off by one task, or, with `chunk`, by a task for so many order values (bytes of a
    file, say): then only what each chunk ends with is passed on to the next ones.
    """
    begin = F.when(~F.coalesce(continues, F.lit(False)), F.col(order))
    if chunk is None:
        by_place = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        placed = lines.withColumn("_at", F.coalesce(F.last(begin, ignorenulls=True).over(by_place), F.min(order).over(by_place)))
    else:
        parted = lines.withColumns({"_chunk": F.floor(F.col(order) / F.lit(chunk)), "_begin": begin})
        by_place = Window.partitionBy(source, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ends = parted.groupBy(source, "_chunk").agg(F.max("_begin").alias("_last"), F.min(order).alias("_first"))  # a row a chunk
        earlier = Window.partitionBy(source).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        opened = F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.min("_first").over(Window.partitionBy(source)))
        placed = parted.withColumn("_own", F.last("_begin", ignorenulls=True).over(by_place)).join(ends.select(source, "_chunk", opened.alias("_open")), [source, "_chunk"])
        placed = placed.withColumn("_at", F.coalesce("_own", "_open"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = placed.groupBy(source, "_at").agg(F.max(order).alias("last"), F.count("*").alias("lines"), parts.alias("parts"))
    return grouped.select(source, F.col("_at").alias("start"), "last", "lines", F.array_join(F.col("parts.t"), "\n").alias("text"))
