"""Acceptance of label sets and records: a reason column, null where all is well; the first rule that fails names it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the data model, in bytes and entries; times in seconds.
MESSAGE, FIELDS, FIELD_NAME, FIELD_VALUE = 65536, 64, 128, 8192
LABELS, LABEL_NAME, LABEL_VALUE = 32, 128, 1024
FUTURE, BACKFILL = 15 * 60, 7 * 86400
RESERVED = ("service", "host", "env", "level")


def label_reason(service: Column, host: Column, env: Column, labels: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, value in (("service", service), ("host", host), ("env", env)):
        out = out.when(F.coalesce(value, F.lit("")) == "", f"missing label {name}")
        out = out.when(F.octet_length(value) > LABEL_VALUE, f"label too long {name}")
    names = F.map_keys(labels)
    return (
        out.when(F.size(labels) > LABELS, "too many labels")
        .when(F.exists(names, lambda n: n == ""), "empty label name")
        .when(F.exists(names, lambda n: F.octet_length(n) > LABEL_NAME), "label name too long")
        .when(F.exists(names, lambda n: ~n.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")), "invalid label name")
        .when(F.exists(names, lambda n: n.isin(*RESERVED)), "reserved label")
        .when(F.exists(F.map_values(labels), lambda v: F.octet_length(v) > LABEL_VALUE), "label value too long")
    )


def record_reason(now: Column) -> Column:
    """Of rows with the columns of a log record, judged against `now`."""
    time, level = F.col("time"), F.col("level")
    trace, span = F.octet_length("trace_id"), F.octet_length("span_id")
    names, values = F.map_keys("fields"), F.map_values("fields")
    return (
        F.when(time.isNull(), "missing time")
        .when(time > now + F.make_dt_interval(secs=F.lit(FUTURE)), "time in the future")
        .when(time < now - F.make_dt_interval(secs=F.lit(BACKFILL)), "time too old")
        .when(F.col("seq") < 0, "negative seq")
        .when(level.isNull() | ~level.between(0, 6), "invalid level")
        .when(F.octet_length("message") > MESSAGE, "message too long")
        .when((trace != 0) & (trace != 16), "bad trace id")
        .when((span != 0) & (span != 8), "bad span id")
        .when(F.size("fields") > FIELDS, "too many fields")
        .when(F.exists(names, lambda n: n == ""), "empty field name")
        .when(F.exists(names, lambda n: F.octet_length(n) > FIELD_NAME), "field name too long")
        .when(F.exists(values, lambda v: F.octet_length(v) > FIELD_VALUE), "field value too long")
    )
