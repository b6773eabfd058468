"""Registered queries of the log engine over the benchmark tables, each with its SQL for DuckDB.

Most entries are a query text, a view, and the SQL of the same question; the others call an operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.engine import Engine, with_labels
from emberlog.functions import extract, fingerprint, ingest_fields, validation
from emberlog.operators import discovery, multiline, report, rollup, storage
from emberlog.plans import levels
from emberlog.plans.compiler import Request, compile_query, tail_predicates
from emberlog.plans.parser import parse
from emberlog.session import shared_folder
from emberlog.sources import adapters, lines, synthetic
from emberlog.streaming import ingest

RECORD = "time, seq, service, host, env, level, message"
_NUM = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"
_LOGFMT = "trim(regexp_extract(message, '(?:^|\\s){k}=(\"[^\"\\s]*\\s[^\"]*\"|\\S*)', 1), '\"')"


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _sql(view: str, body: str) -> str:
    return f"WITH {view} AS ({adapters.SQL_VIEWS[view]})\n{body}"


def records(name: str, view: str, text: str, where: str, forward: bool = False, limit: int | None = None, span: tuple[datetime | None, datetime | None] = (None, None)) -> None:
    """A record query; `where` is its condition in SQL, times included."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = adapters.catalog_of(adapters.VIEWS[view](spark, sf_dir))
        plan = compile_query(text, Request(*span, limit, forward), catalog)
        return with_labels(plan.df, catalog.streams).select(*RECORD.split(", "))

    way = "" if limit is None else f" ORDER BY time {'ASC' if forward else 'DESC'}, seq {'ASC' if forward else 'DESC'} LIMIT {limit}"
    ENTRIES[name] = Entry(run, _sql(view, f"SELECT {RECORD} FROM {view} WHERE {where}{way}"))


def points(
    name: str, view: str, text: str, width: str, value: str, where: str = "TRUE", by: str = "", rollups: bool = False, span: tuple[datetime | None, datetime | None] = (None, None)
) -> None:
    """An aggregation; `value` and `by` (`expression AS label`) are SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = adapters.catalog_of(adapters.VIEWS[view](spark, sf_dir))
        catalog = adapters.with_rollups(catalog) if rollups else catalog
        df = compile_query(text, Request(*span), catalog).df
        return df.withColumn("level", F.col("level").cast("int")) if "level" in df.columns else df

    group = f", {by}" if by else ""
    ENTRIES[name] = Entry(run, _sql(view, f"SELECT time_bucket(INTERVAL '{width}', time) AS bucket, {value} AS value{group} FROM {view} WHERE {where} GROUP BY ALL"))


def operator(name: str, sql: str | None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


# ---------------------------------------------------------------- selectors

for op, sql in (("eq", "="), ("neq", "<>"), ("gte", ">="), ("lte", "<="), ("gt", ">"), ("lt", "<")):
    word = "purchase" if op not in ("eq", "neq") else "error"
    records(f"sel_{op}", "ev", f'{{service{"!=" if op == "neq" else sql}"{word}"}}', f"service {sql} '{word}'")
    records(f"sel_level_{op}", "ev", f'{{level{"!=" if op == "neq" else sql}"info"}}', f"level {sql} 3")
records("sel_re", "ev", '{service=~"err.*|view"}', "regexp_full_match(service, 'err.*|view')")
records("sel_nre", "ev", '{service!~"err.*|vie"}', "NOT regexp_full_match(service, 'err.*|vie')")
records("sel_re_flag", "ev", '{service=~"(?i)ERROR"}', "regexp_full_match(service, '(?i)ERROR')")
records("sel_extra_eq", "ev", '{region="eu"}', "region = 'eu'")
records("sel_extra_empty", "ev", '{region=""}', "region = ''")
records("sel_extra_neq", "ev", '{region!="eu"}', "coalesce(region, '') <> 'eu'")
records("sel_extra_re", "ev", '{region=~"e.|us"}', "regexp_full_match(coalesce(region, ''), 'e.|us')")
records("sel_extra_nre", "ev", '{region!~"e.*"}', "NOT regexp_full_match(coalesce(region, ''), 'e.*')")
records("sel_extra_gte", "ev", '{region>="f"}', "coalesce(region, '') >= 'f'")
records("sel_extra_lte", "ev", '{region<="eu"}', "coalesce(region, '') <= 'eu'")
records("sel_extra_gt", "ev", '{region>""}', "coalesce(region, '') > ''")
records("sel_extra_lt", "ev", '{region<"f"}', "coalesce(region, '') < 'f'")
records("sel_level_alias", "ev", '{level="err"}', "level = 5")
records("sel_mixed", "ev", '{service!="view", host=~"h[0-5]", env="prod", region!="us", level>="debug", host>"h0"}', "service <> 'view' AND regexp_full_match(host, 'h[0-5]') AND env = 'prod' AND coalesce(region, '') <> 'us' AND level >= 2 AND host > 'h0'")
records("sel_none", "ev", '{service="nope"}', "service = 'nope'")

# ---------------------------------------------------------------- line filters

records("line_contains", "evf", '{env="prod"} |= "OP=click"', "env = 'prod' AND contains(lower(message), 'op=click')")
records("line_not_contains", "evf", '{env="prod"} != "OP=click"', "env = 'prod' AND NOT contains(lower(message), 'op=click')")
records("line_literal_meta", "doc", '{env="corpus"} |= "%"', "contains(message, '%')")
records("line_re", "evf", r'{env="prod"} |~ "user=1\\d "', r"env = 'prod' AND regexp_matches(message, 'user=1\d ')")
records("line_nre", "evf", r'{env="prod"} !~ "user=1\\d "', r"env = 'prod' AND NOT regexp_matches(message, 'user=1\d ')")
records("line_re_flag", "evf", '{env="prod"} |~ "(?i)CLICK"', "env = 'prod' AND regexp_matches(message, '(?i)CLICK')")
records("line_re_dotall", "doc", '{host="en"} |~ "And.+the$"', "host = 'en' AND regexp_matches(message, '(?s)And.+the$')")
records("line_re_class", "doc", '{host!="en"} |~ "[[:upper:]][é&&a]|\\\\bder\\\\b"', r"host <> 'en' AND regexp_matches(message, '[[:upper:]][é&a]|\bder\b')")

# ---------------------------------------------------------------- fields and parser stages

records("fields_text", "ev", '{env=~".*"} | k = "5"', "coalesce(k, '') = '5'")
records("fields_num", "ev", '{env=~".*"} | cents >= 5000', f"regexp_matches(cents, {_NUM}) AND cents::DOUBLE >= 5000")
records("fields_num_neq", "ev", '{env=~".*"} | cents != 5000.5', "cents::DOUBLE <> 5000.5")
records("fields_num_lt", "ev", '{env=~".*"} | cents < 0012.50', "cents::DOUBLE < 12.5")
records("fields_re", "ev", '{env=~".*"} | k =~ "1."', "regexp_full_match(coalesce(k, ''), '1.')")
records("fields_nre", "ev", '{env=~".*"} | k !~ "1."', "NOT regexp_full_match(coalesce(k, ''), '1.')")
records("fields_gt_text", "ev", '{env=~".*"} | k > "5" | k <= "7"', "k > '5' AND k <= '7'")
records("fields_missing_neq", "ev", '{env=~".*"} | zzz != "5"', "TRUE")
records("fields_missing_num", "ev", '{env=~".*"} | zzz != 5', "FALSE")
records("json_text", "ev", '{env="prod"} | json | k = "7"', "env = 'prod' AND message->>'$.k' = '7'")
records("json_num", "ev", '{env="prod"} | json | k > 50', "env = 'prod' AND (message->>'$.k')::DOUBLE > 50")
records("json_invalid_neq", "evf", '{env="prod"} | json | k != "5"', "env = 'prod'")
records("json_then_line", "ev", '{env="prod"} | json != "7" | k >= 10', "env = 'prod' AND NOT contains(message, '7') AND (message->>'$.k')::DOUBLE >= 10")
records("logfmt_text", "evf", '{env="prod"} | logfmt | op = "view"', f"env = 'prod' AND {_LOGFMT.format(k='op')} = 'view'")
records("logfmt_quoted", "evf", '{env="prod"} | logfmt | note = "click x"', f"env = 'prod' AND {_LOGFMT.format(k='note')} = 'click x'")
records("logfmt_num", "evf", '{env="prod"} | logfmt | user < 20', f"env = 'prod' AND {_LOGFMT.format(k='user')}::DOUBLE < 20")
records("logfmt_missing", "evf", '{env="prod"} | logfmt | nothing = ""', "env = 'prod'")
records("regexp_text", "evf", '{env="prod"} | regexp `op=(?P<what>\\w+)` | what != "click"', r"env = 'prod' AND regexp_extract(message, 'op=(\w+)', 1) <> 'click'")
records("regexp_num", "evf", '{env="prod"} | regexp `user=(?P<u_id>\\d+)` | u_id >= 100', r"env = 'prod' AND regexp_extract(message, 'user=(\d+)', 1)::DOUBLE >= 100")
records("stage_replace", "evf", '{env="prod"} | json | logfmt | op = "view"', f"env = 'prod' AND {_LOGFMT.format(k='op')} = 'view'")
records("level_stage", "ev", '{env="prod"} | level > "info"', "env = 'prod' AND level > 3")
records("promoted_stage", "ev", '{env="prod"} | json | host != "h1" | service =~ "v.*"', "env = 'prod' AND host <> 'h1' AND regexp_full_match(service, 'v.*')")
records("fields_num_eq", "ev", '{env=~".*"} | k = 7', "k = '7'")
records("fields_num_lte", "ev", '{env=~".*"} | k <= 12.0', "k::DOUBLE <= 12")
records("fields_gte_text", "ev", '{env=~".*"} | k >= "40" | k < "5"', "k >= '40' AND k < '5'")
records("range_start_end", "ev", '{env="prod"}', "env = 'prod' AND time >= TIMESTAMP '2024-01-05 03:04:05.5' AND time < TIMESTAMP '2024-01-17 18:00:00'", span=(datetime(2024, 1, 5, 3, 4, 5, 500_000), datetime(2024, 1, 17, 18)))
records("range_open_end", "evf", '{env="prod"} |= "op=view"', "env = 'prod' AND contains(message, 'op=view') AND time >= TIMESTAMP '2024-01-20 12:00:00'", span=(datetime(2024, 1, 20, 12), None))
records("order_forward_limit", "ev", '{env="prod"}', "env = 'prod'", forward=True, limit=50)
records("order_backward_limit", "ev", '{env="prod"}', "env = 'prod'", limit=50)

# ---------------------------------------------------------------- aggregations

_COUNT, _BYTES = "count(*)::DOUBLE", "sum(octet_length(encode(message)))::DOUBLE"
points("rate_1h", "ev", '{service=~".*"} | rate(1h) by (service)', "1 hour", f"{_COUNT} / 3600", by="service")
points("rate_5m_by_level", "ev", '{env="prod"} | rate(5m) by (level)', "5 minutes", f"{_COUNT} / 300", "env = 'prod'", "level")
points("count_1h_by_service_env", "ev", '{level>="info"} | count_over_time(1h) by (service, env)', "1 hour", _COUNT, "level >= 3", "service, env")
points("count_5h", "ev", '{env="prod"} | count_over_time(5h)', "5 hours", _COUNT, "env = 'prod'")
points("count_7d", "ev", '{env=~".+"} | count_over_time(7d)', "7 days", _COUNT)
points("count_90s", "ev", '{service="error"} | count_over_time(90s)', "90 seconds", _COUNT, "service = 'error'")
points("bytes_5m", "doc", '{env="corpus"} | bytes_over_time(5m)', "5 minutes", _BYTES)
points("bytes_1h_by_host", "evf", '{env="prod"} | bytes_over_time(1h) by (host)', "1 hour", _BYTES, "env = 'prod'", "host")
points("agg_by_json_field", "ev", '{env="prod"} | json | count_over_time(1h) by (k)', "1 hour", _COUNT, "env = 'prod'", "message->>'$.k' AS k")
points("agg_by_missing_null", "ev", '{env="prod"} | json | count_over_time(1d) by (zzz)', "1 day", _COUNT, "env = 'prod'", "NULL::VARCHAR AS zzz")
points("agg_by_extra_label", "ev", '{env="prod"} | count_over_time(1d) by (region)', "1 day", _COUNT, "env = 'prod'", "NULL::VARCHAR AS region")
points("agg_after_pipeline", "evf", '{env="prod"} |= "op=" | logfmt | cents > 1000 | count_over_time(1h) by (op, level)', "1 hour", _COUNT, f"env = 'prod' AND {_LOGFMT.format(k='cents')}::DOUBLE > 1000", "service AS op, level")
points("agg_pre_origin", "ord", '{env="orders"} | count_over_time(5h) by (service)', "5 hours", _COUNT, by="service")
points("agg_conv_by_role", "conv", '{env="corpus"} |~ "[aeiou]" | count_over_time(1h) by (service)', "1 hour", _COUNT, "regexp_matches(message, '[aeiou]')", "service")
_WIDE = (datetime(2024, 1, 4, 7, 30), datetime(2024, 1, 11, 1, 0, 1))  # to whole buckets of five hours, which count from 2000-01-03
_INSIDE = "time >= time_bucket(INTERVAL '5 hours', TIMESTAMP '2024-01-04 07:30:00') AND time < time_bucket(INTERVAL '5 hours', TIMESTAMP '2024-01-11 01:00:01') + INTERVAL '5 hours'"
points("widened_count_5h", "ev", '{env=~".+"} | count_over_time(5h) by (service)', "5 hours", _COUNT, _INSIDE, "service", span=_WIDE)
points("widened_rollup_5h", "ev", '{env=~".+"} | count_over_time(5h) by (service)', "5 hours", _COUNT, _INSIDE, "service", rollups=True, span=_WIDE)
points("rollup_count_1m", "ev", '{env="prod"} | count_over_time(1m) by (level)', "1 minute", _COUNT, "env = 'prod'", "level", rollups=True)
points("rollup_rate_2h", "ev", '{level>="info"} | rate(2h) by (service, host)', "2 hours", f"{_COUNT} / 7200", "level >= 3", "service, host", rollups=True)


# ---------------------------------------------------------------- rollups

_LABELLED = "service, host, env, region"


def _named(rates: DataFrame, streams: DataFrame) -> DataFrame:
    region = F.element_at("labels", F.lit("region")).alias("region")
    return rates.join(streams.select("stream_id", "service", "host", "env", region), "stream_id").select("bucket", "service", "host", "env", "region", F.col("level").cast("int").alias("level"), "n")


def _rate_sql(width: str) -> str:
    return _sql("ev", f"SELECT time_bucket(INTERVAL '{width}', time) AS bucket, {_LABELLED}, level, count(*) AS n FROM ev GROUP BY ALL")


@operator("rollup_1m", _rate_sql("1 minute"))
def rollup_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = adapters.with_rollups(adapters.catalog_of(adapters.ev_rows(spark, sf_dir)))
    return _named(catalog.rollups["logs_rate_1m"], catalog.streams)


@operator("rollup_1h", _rate_sql("1 hour"))
def rollup_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = adapters.with_rollups(adapters.catalog_of(adapters.ev_rows(spark, sf_dir)))
    return _named(catalog.rollups["logs_rate_1h"], catalog.streams)


@operator("rollup_equals_raw", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS rolled, count(*) AS raw FROM events GROUP BY 1")
def rollup_equals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = adapters.with_rollups(adapters.catalog_of(adapters.ev_rows(spark, sf_dir)))
    rolled = catalog.rollups["logs_rate_1h"].groupBy("bucket").agg(F.sum("n").alias("rolled"))
    from emberlog.plans.compiler import bucket

    raw = catalog.logs.groupBy(bucket(F.col("time"), 3600).alias("bucket")).agg(F.count("*").alias("raw"))
    return rolled.join(raw, "bucket", "full").select("bucket", "rolled", "raw")


@operator("rollup_realtime_union", _rate_sql("1 minute"))
def rollup_realtime_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = adapters.with_rollups(adapters.catalog_of(adapters.ev_rows(spark, sf_dir)))
    return _named(rollup.real_time(catalog.rollups["logs_rate_1m"], catalog.logs, datetime(2024, 1, 15, 12, 0, 30)), catalog.streams)


# ---------------------------------------------------------------- discovery


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.catalog_of(adapters.ev_rows(spark, sf_dir)).streams


@operator("labels_names", _sql("ev", "SELECT DISTINCT unnest(['service', 'host', 'env', 'level'] || CASE WHEN region IS NULL THEN []::VARCHAR[] ELSE ['region'] END) AS name FROM ev"))
def labels_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.label_names(_streams(spark, sf_dir))


for _label, _condition in (("service", "TRUE"), ("region", "region IS NOT NULL")):
    ENTRIES[f"labels_values_{'promoted' if _label == 'service' else 'extra'}"] = Entry(
        lambda spark, sf_dir, name=_label: discovery.label_values(_streams(spark, sf_dir), name), _sql("ev", f"SELECT DISTINCT {_label} AS value FROM ev WHERE {_condition}")
    )
ENTRIES["labels_values_level"] = Entry(
    lambda spark, sf_dir: discovery.label_values(_streams(spark, sf_dir), "level"), "SELECT unnest(['unspecified', 'trace', 'debug', 'info', 'warn', 'error', 'fatal']) AS value"
)


# ---------------------------------------------------------------- ingest


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, and every third one again as a replay."""
    rows = adapters.labelled(adapters.ev_rows(spark, sf_dir))
    return rows.unionByName(rows.where("seq % 3 = 0"))


@operator("ingest_dedup", _sql("ev", f"SELECT {RECORD} FROM ev"))
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubled(spark, sf_dir)
    stored = rows.where("seq % 2 = 0").dropDuplicates(storage.KEY)
    fresh = storage.new_rows(rows, stored)
    return stored.unionByName(fresh).withColumn("level", F.col("level").cast("int")).select(*RECORD.split(", "))


_REASON_SQL = """WITH r AS (SELECT event_id AS seq, ts, CASE event_id % 11 WHEN 1 THEN NULL WHEN 2 THEN TIMESTAMP '2024-01-30 00:15:01' + INTERVAL 1 DAY ELSE ts END AS time,
  CASE WHEN event_id % 11 = 3 THEN -event_id ELSE event_id END AS s, CASE WHEN event_id % 11 = 4 THEN 9 ELSE 3 END AS level, event_id % 11 AS x FROM events)
SELECT CASE WHEN x = 6 THEN 'missing label service' WHEN x = 7 THEN 'reserved label' WHEN x = 8 THEN 'invalid label name' WHEN time IS NULL THEN 'missing time'
  WHEN time > TIMESTAMP '2024-01-30' + INTERVAL 15 MINUTE THEN 'time in the future' WHEN time < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY THEN 'time too old'
  WHEN s < 0 THEN 'negative seq' WHEN level > 6 THEN 'invalid level' WHEN x = 5 THEN 'message too long' WHEN x = 9 THEN 'bad trace id' WHEN x = 10 THEN 'empty field name' ELSE 'accepted' END AS reason,
  count(*) AS n FROM r GROUP BY 1"""


@operator("ingest_validate_reasons", _REASON_SQL)
def ingest_validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.read(spark, sf_dir, "events")
    x = F.col("event_id") % 11
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    late = F.lit("2024-01-31 00:15:01").cast("timestamp_ntz")
    name = F.when(x == 7, "level").when(x == 8, "9lives").otherwise("region")
    rows = e.select(
        F.when(x == 1, None).when(x == 2, late).otherwise(F.col("ts")).alias("time"), F.when(x == 3, -F.col("event_id")).otherwise(F.col("event_id")).alias("seq"),
        F.when(x == 4, 9).otherwise(3).alias("level"), F.when(x == 5, F.repeat(F.lit("m"), 65537)).otherwise(F.col("props")).alias("message"),
        F.when(x == 6, "").otherwise(F.col("event_type")).alias("service"), F.lit("h").alias("host"), F.lit("e").alias("env"), F.create_map(name, F.lit("v")).alias("labels"),
        F.when(x == 9, F.lit("abc").cast("binary")).alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), F.create_map(F.when(x == 10, "").otherwise("k"), F.lit("v")).alias("fields"),
    )
    labels = validation.label_reason(F.col("service"), F.col("host"), F.col("env"), F.col("labels"))
    return report.outcome_counts(rows.select(F.coalesce(labels, validation.record_reason(now)).alias("reason")))


@operator("dim_upsert", _sql("ev", f"SELECT {_LABELLED}, min(time) AS first_seen, max(time) AS last_seen FROM ev GROUP BY ALL"))
def dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.ev_rows(spark, sf_dir)
    old = adapters.catalog_of(rows.where("seq % 2 = 0")).streams
    new = adapters.catalog_of(rows.where("seq % 2 = 1")).streams
    both = storage.upserted(old, new)
    return both.select("service", "host", "env", F.element_at("labels", F.lit("region")).alias("region"), "first_seen", "last_seen")


@operator("retention", _sql("ev", "SELECT seq, time FROM ev WHERE time >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY"))
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.retained(adapters.catalog_of(adapters.ev_rows(spark, sf_dir)).logs, datetime(2024, 2, 10)).select("seq", "time")


@operator("accepted_by_service_level", _sql("ev", "SELECT service, level, count(*) AS n FROM ev GROUP BY ALL"))
def accepted_by_service_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.accepted_counts(adapters.ev_rows(spark, sf_dir)).withColumn("level", F.col("level").cast("int"))


_MULTILINE_SQL = """WITH l AS (SELECT conv_id AS source, turn AS start, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 OR role <> 'assistant' AS b FROM conversations),
r AS (SELECT *, sum(b::INT) OVER (PARTITION BY source ORDER BY start) AS rec FROM l)
SELECT source, min(start) AS start, max(start) AS last, count(*) AS lines, string_agg(text, chr(10) ORDER BY start) AS text FROM r GROUP BY source, rec"""


@operator("multiline_batch", _MULTILINE_SQL)
def multiline_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("start"), F.col("text").alias("line"), "role")
    return multiline.joined(rows, F.col("role") == "assistant")


@operator("loadgen_percentiles", "WITH p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0]::DOUBLE[]) AS p), r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events) SELECT p, min(value) AS value FROM r JOIN p ON k >= ceil(p * n) GROUP BY p")
def loadgen_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nearest_rank(adapters.read(spark, sf_dir, "events"), "value", [0.5, 0.9, 0.95, 0.99, 1.0])


# ---------------------------------------------------------------- single functions


@operator("level_names", "SELECT DISTINCT event_type AS text, CASE event_type WHEN 'error' THEN 5 ELSE 0 END AS level, CASE event_type WHEN 'error' THEN 'error' ELSE 'unspecified' END AS name FROM events")
def level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = adapters.read(spark, sf_dir, "events").select(F.col("event_type").alias("text")).distinct()
    number = levels.number_column(F.concat(F.lit(" "), F.upper("text")))
    return kinds.select("text", number.cast("int").alias("level"), levels.name_column(number).alias("name"))


@operator("routing_token", "SELECT p_name AS name, substr(regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) AS token FROM part")
def routing_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), lines.routing_token(F.col("p_name")).alias("token"))


@operator("container_lines", "SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS time, CASE WHEN event_id % 4 = 0 THEN 'no time ' || props ELSE props END AS message FROM events")
def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.read(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("no time "), "props")).otherwise(F.concat(stamp, F.lit("789Z "), "props"))
    time, message = lines.container_split(raw)
    # the session's zone doesn't matter: from the instant to UTC
    utc = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.unix_micros("t") / F.lit(1000000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return e.select(F.col("event_id").alias("seq"), time.alias("t"), message.alias("message")).select("seq", utc.alias("time"), "message")


@operator("label_flatten", _sql("ev", """SELECT DISTINCT '{"env":"' || env || '","host":"' || host || '"' || CASE WHEN region IS NULL THEN '' ELSE ',"region":"' || region || '"' END || ',"service":"' || service || '"}' AS labels FROM ev"""))
def label_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = extract.all_labels(F.col("service"), F.col("host"), F.col("env"), F.col("labels"))
    return _streams(spark, sf_dir).select(extract.sorted_json(merged).alias("labels"))


@operator("hex_ids", "SELECT event_id AS seq, lower(hex(event_type)) AS trace FROM events")
def hex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), extract.hex_id(F.col("event_type").cast("binary")).alias("trace"))


@operator("synthetic_levels", "SELECT level, count(*) AS n FROM (SELECT [2, 3, 3, 3, 4, 5][CAST(event_id % 6 AS INT) + 1] AS level FROM events) GROUP BY 1")
def synthetic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.read(spark, sf_dir, "events").count()
    return synthetic.records(spark, n).groupBy(F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


@operator("pacing_schedule", "SELECT event_id AS n, CASE WHEN event_id < 5000 THEN sqrt(2 * event_id * 10.0::DOUBLE / 1000) ELSE 10 + (event_id - 5000) / 1000.0::DOUBLE END AS at FROM events")
def pacing_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "events").select(F.col("event_id").alias("n"), synthetic.release_at(F.col("event_id"), 1000.0, 10.0).alias("at"))


@operator("tail_equals_query", _sql("evf", f"SELECT {RECORD} FROM evf WHERE env = 'prod' AND level >= 3 AND contains(message, 'user=1')"))
def tail_equals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.evf_rows(spark, sf_dir).withColumn("labels", F.create_map(F.lit("region"), F.col("region")))
    on_streams, on_records = tail_predicates(parse('{env="prod", level>="info"} |= "user=1"'))
    return rows.where(on_streams & on_records).withColumn("level", F.col("level").cast("int")).select(*RECORD.split(", "))


@operator("stream_ids", "SELECT count(*) AS sets, count(*) AS ids FROM (SELECT DISTINCT service, host, env, region FROM (" + adapters.SQL_VIEWS["ev"] + "))")
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many ids as label sets."""
    named = fingerprint.with_stream_ids(adapters.with_label_map(adapters.ev_rows(spark, sf_dir)))
    return named.agg(F.count_distinct("service", "host", "env", F.to_json("labels")).alias("sets"), F.count_distinct("stream_id").alias("ids"))


@operator("fields_by_pattern", _sql("evf", r"SELECT seq, service AS op, regexp_extract(message, 'user=(\d+)', 1) AS user FROM evf"))
def fields_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ingest_fields.extracted(F.col("message"), False, r"op=(?P<op>\w+) user=(?<user>\d+)")
    return adapters.evf_rows(spark, sf_dir).select("seq", fields.alias("f")).select("seq", F.col("f")["op"].alias("op"), F.col("f")["user"].alias("user"))


@operator("fields_by_json", "SELECT event_id AS seq, json_extract_string(props, '$.k') AS k, 3 AS n, 8192 AS long FROM events")
def fields_by_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a JSON line, with the limit of a value's bytes."""
    line = F.concat(F.lit('{"long":"'), F.repeat(F.lit("é"), F.lit(5000)), F.lit('","none":null,'), F.substring("props", F.lit(2), F.length("props")))
    fields = ingest_fields.extracted(line)
    return adapters.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), fields.alias("f")).select("seq", F.col("f")["k"].alias("k"), F.size("f").alias("n"), F.octet_length(F.col("f")["long"]).alias("long"))


@operator("agent_records", _sql("ev", "SELECT seq, CASE WHEN service = 'error' THEN 'api' ELSE service END AS service, level, message FROM (SELECT seq, service, CASE WHEN service = 'error' THEN 5 ELSE 0 END AS level, '{\"level\":\" ' || upper(service) || '\",\"app\":\"' || CASE WHEN service = 'error' THEN 'api' ELSE '' END || '\",\"seq\":' || seq || '}' AS message FROM ev)"))
def agent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files to records: level and service from fields, the service from the file's name where there is none."""
    app = F.when(F.col("service") == "error", "api").otherwise("")
    line = F.concat(F.lit('{"level":" '), F.upper("service"), F.lit('","app":"'), app, F.lit('","seq":'), F.col("seq"), F.lit("}\r"))
    rows = adapters.ev_rows(spark, sf_dir).select(F.concat(F.lit("/var/log/"), "service", F.lit(".log")).alias("source"), "time", F.col("seq").alias("start"), line.alias("line"))
    return lines.records(rows, "h", "prod", service_field="app").select("seq", "service", F.col("level").cast("int").alias("level"), "message")


@operator("container_records", "SELECT epoch_ns(ts) + 789 AS seq, event_type || '-stderr' AS service, props AS message FROM events")
def container_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.read(spark, sf_dir, "events")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z "), "props")
    rows = e.select(raw.alias("line"), F.lit(None).cast("timestamp").alias("time"), F.lit(None).cast("long").alias("start"), "event_type")
    return lines.container_lines(rows, F.col("event_type"), F.lit("stderr")).select(F.col("start").alias("seq"), "service", F.col("line").alias("message"))


@operator("line_assembly", "SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 65536 ELSE octet_length(encode(props)) END AS bytes FROM events")
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carriage return goes; a long line is cut at a whole character."""
    raw = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("ä"), F.lit(33_000))).otherwise(F.concat("props", F.lit("\r")))
    return adapters.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.octet_length(lines.assembled(raw)).alias("bytes"))


@operator("manual_send", "SELECT * FROM (VALUES (0, 'one', 4, 'svc'), (1, 'two', 4, 'svc')) AS t(seq, message, level, service)")
def manual_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = lines.manual(spark, ["one", "two\r"], "svc", "h", "prod", "WARNING", datetime(2024, 1, 1))
    return sent.select("seq", "message", F.col("level").cast("int").alias("level"), "service")


@operator("storage_bytes", _sql("evf", "SELECT sum(26 + octet_length(encode(message)))::BIGINT AS raw, count(*) AS n FROM evf"))
def storage_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.evf_rows(spark, sf_dir).agg(F.sum(storage.raw_bytes()).cast("long").alias("raw"), F.count("*").alias("n"))


@operator("truncated_flag", _sql("ev", "SELECT l.n AS most, least(l.n, (SELECT count(*) FROM ev WHERE service = 'error')) AS got, (SELECT count(*) FROM ev WHERE service = 'error') > l.n AS truncated FROM (SELECT unnest([1, 7, 5000]) AS n) l"))
def truncated_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine says of a query that has more records than its limit; the walk from the newest on."""
    engine = Engine(adapters.catalog_of(adapters.ev_rows(spark, sf_dir)))
    found = [(n, engine.query('{service="error"}', datetime(2023, 1, 1), datetime(2030, 1, 1), n)) for n in (1, 7, 5000)]
    return spark.createDataFrame([(n, len(r.records), r.truncated) for n, r in found], "most int, got long, truncated boolean")


# ---------------------------------------------------------------- the write path, into a store in the shared folder

_NOW = datetime(2024, 1, 20)  # UTC
#: What a store of that moment accepts: seven days back, fifteen minutes ahead.
_ACCEPTED = "time >= TIMESTAMP '2024-01-13' AND time <= TIMESTAMP '2024-01-20 00:15:00'"


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as records with labels, every third one again, and one of the far future."""
    rows = adapters.with_label_map(adapters.ev_rows(spark, sf_dir)).withColumn("time", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "time")))
    ids = {"trace_id": F.lit(None).cast("binary"), "span_id": F.lit(None).cast("binary")}
    rows = rows.withColumns(ids).select("time", "seq", "level", "message", "service", "host", "env", "labels", "trace_id", "span_id", "fields")
    ahead = rows.where("seq % 1000 = 0").withColumns({"time": F.lit(datetime(2099, 1, 1)).cast("timestamp"), "seq": F.col("seq") + 10**12})
    return rows.unionByName(rows.where("seq % 3 = 0")).unionByName(ahead)


def _store(spark: SparkSession) -> ingest.Store:
    return ingest.Store(f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str) -> ingest.Store:
    """Two batches that overlap, the second one sent twice."""
    store, rows = _store(spark), _incoming(spark, sf_dir)
    for part in (rows.where("seq % 5 < 3"), rows.where("seq % 5 > 1"), rows.where("seq % 5 > 1")):
        ingest.write_batch(part, store, _NOW)
    return store


def _plain_time(column: str) -> F.Column:
    """Without a zone, as the tables have it, whatever the session's zone is."""
    return (F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.unix_micros(column) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))).alias(column)


def _found(spark: SparkSession, store: ingest.Store) -> DataFrame:
    catalog = ingest.catalog(spark, store)
    found = with_labels(compile_query('{env=~".+"}', Request(None, None, None), catalog).df, catalog.streams)
    return found.select(_plain_time("time"), *RECORD.split(", ")[1:])


@operator("stored_records", _sql("ev", f"SELECT {RECORD} FROM ev WHERE {_ACCEPTED}"))
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, _stored(spark, sf_dir))


@operator("stored_compacted", _sql("ev", f"SELECT {RECORD} FROM ev WHERE {_ACCEPTED}"))
def stored_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    ingest.compact(spark, store, datetime(2024, 1, 22))
    return _found(spark, store)


@operator("stored_rollup_1h", _sql("ev", f"SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, {_COUNT} AS value, service, level FROM ev WHERE {_ACCEPTED} GROUP BY ALL"))
def stored_rollup_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compile_query('{env=~".+"} | count_over_time(1h) by (service, level)', Request(None, None), ingest.catalog(spark, _stored(spark, sf_dir)))
    return plan.df.select(_plain_time("bucket"), "value", "service", F.col("level").cast("int").alias("level"))


@operator("stored_streams", _sql("ev", f"SELECT service, host, env, region FROM ev WHERE {_ACCEPTED} GROUP BY ALL"))
def stored_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = ingest.catalog(spark, _stored(spark, sf_dir)).streams
    return streams.select("service", "host", "env", F.element_at("labels", F.lit("region")).alias("region"))


_BATCHES = "(seq % 5 < 3)::INT + 2 * (seq % 5 > 1)::INT"  # how often a record comes in
_TWICE = "CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END"


@operator(
    "stored_rejects",
    _sql("ev", f"""SELECT reason, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN time < TIMESTAMP '2024-01-13' THEN 'time too old' ELSE 'time in the future' END AS reason, ({_BATCHES}) * {_TWICE} AS n FROM ev WHERE NOT ({_ACCEPTED})
  UNION ALL SELECT 'time in the future', (seq % 5 < 3)::INT + 2 * (seq % 5 > 1)::INT FROM ev WHERE seq % 1000 = 0) GROUP BY reason"""),
)
def stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.outcome_counts(spark.read.parquet(_stored(spark, sf_dir).rejected))


@operator("streamed_records", _sql("ev", f"SELECT {RECORD} FROM ev WHERE {_ACCEPTED}"))
def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that takes all there is, in two runs; the records of 2099 come first."""
    store = _store(spark)
    folder = f"{store.root}/_in"
    rows = _incoming(spark, sf_dir)
    for part in (rows.where("seq >= 1000000000000"), rows.where("seq < 1000000000000")):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        query = ingest.start(stream, store, f"{store.root}/_checkpoint", _NOW, once=True)
        query.awaitTermination()
    return _found(spark, store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by the hour."""
    catalog = adapters.catalog_of(adapters.ev_rows(spark, sf_dir))
    return compile_query('{service="error"} | count_over_time(1h)', Request(None, None), catalog).df


