"""Counts and percentiles of what was ingested, and rendering of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.extract import hex_id
from emberlog.plans import levels


def accepted_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("service", "level").agg(F.count("*").alias("n"))


def outcome_counts(reasons: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n); accepted rows have the reason `accepted`."""
    return reasons.groupBy(F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


class Counters:
    """Totals over the batches of an ingest: add each result of `write_batch`, or hand `add` to `ingest.start`."""

    def __init__(self) -> None:
        self.totals = dict.fromkeys(("received", "written", "deduped", "rejected"), 0)
        self.reasons: dict[str, int] = {}

    def add(self, batch: dict) -> None:
        for name in self.totals:
            self.totals[name] += batch[name]
        for reason, n in batch["reasons"].items():
            self.reasons[reason] = self.reasons.get(reason, 0) + n

    def exposed(self) -> str:
        """The totals in the text format that metric servers read."""
        lines = []
        for name in ("received", "written", "deduped"):
            lines += [f"# TYPE emberlog_records_{name}_total counter", f"emberlog_records_{name}_total {self.totals[name]}"]
        lines.append("# TYPE emberlog_records_rejected_total counter")
        quote = lambda text: text.replace("\\", "\\\\").replace('"', '\\"')
        lines += [f'emberlog_records_rejected_total{{reason="{quote(reason)}"}} {n}' for reason, n in sorted(self.reasons.items())]
        return "\n".join(lines) + "\n"


def nearest_rank(rows: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """(p, value): the smallest value that at least a share p of the rows doesn't exceed.

    Values are counted before they are ranked; ranks within range partitions follow from the
    partitions' totals, so no task sees all values.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    # the share of rows below each value needs the totals of the parts before its own
    cuts = counts.agg(F.percentile_approx("value", [k / 64 for k in range(1, 64)], 6400).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    from pyspark.sql import Window

    parted = counts.withColumn("part", part)
    totals = parted.groupBy("part").agg(F.sum("n").alias("m"))  # 64 rows at most
    before = totals.alias("a").join(F.broadcast(totals.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.m"), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parted.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(before), "part").select("value", (F.col("upto") + F.col("before")).alias("upto"))
    wanted = F.broadcast(spark.createDataFrame([(p,) for p in ps], "p double"))
    need = F.ceil(F.col("p") * F.col("total"))
    return ranked.join(total).join(wanted, F.col("upto") >= need).groupBy("p").agg(F.min("value").alias("value"))


def rendered(records: DataFrame) -> DataFrame:
    """Records with level names and hex ids, ready for JSON."""
    return records.select(
        "time", F.col("stream_id").cast("string").alias("stream_id"), "seq", levels.name_column(F.col("level")).alias("level"), "message",
        hex_id(F.col("trace_id")).alias("trace_id"), hex_id(F.col("span_id")).alias("span_id"), "fields",
    )


def text_row(record: dict) -> str:
    """A record for people: time, level, message, and its fields in order."""
    pairs = " ".join(f"{k}={v}" for k, v in sorted((record.get("fields") or {}).items()))
    return " ".join(str(x) for x in (record["time"], record["level"], record["message"], pairs) if x not in (None, ""))


def json_line(record: dict) -> str:
    return json.dumps(record, default=str, sort_keys=True, ensure_ascii=False)
