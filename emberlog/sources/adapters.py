"""The benchmark tables as log data: `streams` and `logs` views of events, documents, conversations and orders.

Times stay without zone, as the tables have them.  Stream ids of these views need no fixed encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import rollup
from emberlog.plans.compiler import COLUMNS, Catalog



def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(rows: DataFrame) -> DataFrame:
    """Rows with time, seq, service, host, env, region, level, message and fields, and the id of their stream."""
    return rows.withColumn("stream_id", F.xxhash64("service", "host", "env", "region"))


def with_label_map(rows: DataFrame) -> DataFrame:
    """The region as a map of extra labels."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.withColumn("labels", F.when(F.col("region").isNull(), none).otherwise(F.create_map(F.lit("region"), F.col("region"))))


def catalog_of(rows: DataFrame) -> Catalog:
    """Splits labelled rows into the two tables."""
    rows = labelled(rows)
    keys = ["stream_id", "service", "host", "env", "region"]
    streams = rows.groupBy(*keys).agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    streams = with_label_map(streams).select("stream_id", "service", "host", "env", "labels", "first_seen", "last_seen")
    logs = rows.withColumns({"trace_id": F.lit(None).cast("binary"), "span_id": F.lit(None).cast("binary")}).select(*COLUMNS)
    return Catalog(streams, logs)


def with_rollups(catalog: Catalog) -> Catalog:
    minute = rollup.per_minute(catalog.logs)
    return Catalog(catalog.streams, catalog.logs, {"logs_rate_1m": minute, "logs_rate_1h": rollup.per_hour(minute)}, catalog.partition)


def _cents() -> Column:
    return F.round(F.col("value") * 100).cast("long").cast("string")


def ev_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    region = F.when(user % 5 == 0, None).when(user % 2 == 0, "eu").otherwise("us")
    level = F.when(kind == "error", 5).when(kind.isin("purchase", "signup"), 3).when(kind == "view", 2).otherwise(1).cast("short")
    return e.select(
        F.col("ts").alias("time"), F.col("event_id").alias("seq"), kind.alias("service"), F.concat(F.lit("h"), (user % 8).cast("string")).alias("host"),
        F.when(user % 3 == 0, "prod").otherwise("staging").alias("env"), region.alias("region"), level.alias("level"), F.col("props").alias("message"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("cents"), _cents()).alias("fields"), user.alias("user"), _cents().alias("cents"),
    )


def evf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev_rows(spark, sf_dir)
    message = F.format_string('op=%s user=%d note="%s x" cents=%s', "service", "user", "service", "cents")
    return rows.withColumns({"message": message, "fields": F.lit(None).cast("map<string,string>")})


def _plain(df: DataFrame, time: Column, seq: Column, service: Column, host: Column, env: str, message: Column) -> DataFrame:
    return df.select(
        time.alias("time"), seq.cast("long").alias("seq"), service.alias("service"), host.alias("host"), F.lit(env).alias("env"), F.lit(None).cast("string").alias("region"),
        F.lit(0).cast("short").alias("level"), message.alias("message"), F.lit(None).cast("map<string,string>").alias("fields"),
    )


def _after_2024(seconds: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return _plain(d, _after_2024(F.col("doc_id") * 60), F.col("doc_id"), F.col("source"), F.col("lang"), "corpus", F.col("text"))


def conv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return _plain(c, _after_2024(seq), seq, F.col("role"), F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")), "corpus", F.col("text"))


def ord_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return _plain(o, F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), "orders", F.col("o_orderpriority"))


VIEWS = {"ev": ev_rows, "evf": evf_rows, "doc": doc_rows, "conv": conv_rows, "ord": ord_rows}

_EVENT = """SELECT ts AS time, event_id AS seq, event_type AS service, 'h' || (user_id % 8) AS host,
  CASE WHEN user_id % 3 = 0 THEN 'prod' ELSE 'staging' END AS env,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'eu' ELSE 'us' END AS region,
  CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS level,
  {message} AS message, {fields}
  FROM events"""
_C = "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"
_PLAIN = "SELECT {time} AS time, {seq} AS seq, {service} AS service, {host} AS host, '{env}' AS env, NULL::VARCHAR AS region, 0 AS level, {message} AS message FROM {table}"
#: The same views for DuckDB.
SQL_VIEWS = {
    "ev": _EVENT.format(message="props", fields=f"props->>'$.k' AS k, {_C} AS cents"),
    "evf": _EVENT.format(message=f"'op=' || event_type || ' user=' || user_id || ' note=\"' || event_type || ' x\" cents=' || {_C}", fields="NULL AS k"),
    "doc": _PLAIN.format(time="TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60)", seq="doc_id", service="source", host="lang", env="corpus", message="text", table="documents"),
    "conv": _PLAIN.format(time="TIMESTAMP '2024-01-01' + to_seconds(conv_id * 1000 + turn)", seq="conv_id * 1000 + turn", service="role", host="'c' || (conv_id % 4)", env="corpus", message="text", table="conversations"),
    "ord": _PLAIN.format(time="o_orderdate", seq="o_orderkey", service="o_orderstatus", host="o_orderpriority", env="orders", message="o_orderpriority", table="orders"),
}
