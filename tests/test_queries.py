from datetime import date, datetime, timedelta

import pytest

from emberlog.engine import Engine
from emberlog.operators import rollup
from emberlog.plans.ast import QueryError
from emberlog.plans.compiler import Catalog, Request, bucket, compile_query, floored, source_of, widened
from emberlog.plans.parser import parse
from emberlog.streaming import tail

START = datetime(2025, 3, 10)
HOUR = (START, START + timedelta(hours=1))
STREAMS = "stream_id long, service string, host string, env string, labels map<string,string>"
LOGS = "time timestamp_ntz, stream_id long, seq long, level short, message string, trace_id binary, span_id binary, fields map<string,string>"


def log(stream, seq, seconds, level, message, fields=None):
    return (START + timedelta(seconds=seconds), stream, seq, level, message, None, None, fields)


@pytest.fixture(scope="module")
def catalog(spark):
    """A press and a mill; the press weighs pears."""
    streams = spark.createDataFrame([(21, "press", "barn", "farm", {}), (22, "mill", "barn", "farm", {"river": "ilm"})], STREAMS)
    rows = [log(s, k, 2 * k, 3, f"crate {k} of pears") for s in (21, 22) for k in range(4)]
    rows += [
        log(21, 30, 20, 5, '{"kilos": 41.5, "worker": "Ida"}', {"kilos": "41.5"}),
        log(21, 31, 21, 2, 'kind=quince kilos=12 note="two baskets"'),
        log(21, 32, 22, 3, "[1, 2"),
    ]
    logs = spark.createDataFrame(rows, LOGS)
    minutes = rollup.per_minute(logs)
    return Catalog(streams, logs, {"logs_rate_1m": minutes, "logs_rate_1h": rollup.per_hour(minutes)})


RECORDS = {
    "|= `CRATE 2`": [2], "!= `pears`": [32, 31, 30], "|~ `^crate [13] `": [3, 1], "| kilos > 40": [30], "| json | kilos > 41.4": [30], "| json | worker = `Ida`": [30],
    "| json | worker != `Ida`": [32, 31, 3, 2, 1, 0], "| logfmt | note = `two baskets`": [31], "| logfmt | kilos <= 12.0": [31],
    "| regexp `^crate (?P<no>\\d) of (?P<what>\\w+)$` | no >= 3": [3], "| level >= `warning`": [30], "| level < `info`": [31],
}


@pytest.mark.parametrize("steps", RECORDS)
def test_records(catalog, steps):
    got = Engine(catalog).query('{service="press"} ' + steps, *HOUR, 100)
    assert [r["seq"] for r in got.records] == RECORDS[steps] and not got.truncated


POINTS = {
    "| count_over_time(2m)": ("logs_rate_1m", [(7, {})]), "| count_over_time(2h) by (level)": ("logs_rate_1h", [(1, {"level": "debug"}), (5, {"level": "info"}), (1, {"level": "error"})]),
    "| rate(1m) by (host, service)": ("logs_rate_1m", [(7 / 60, {"service": "press", "host": "barn"})]), "|= `pears` | count_over_time(10m)": ("logs", [(4, {})]),
    "|= `pears` | bytes_over_time(10m)": ("logs", [(64, {})]), "| json | count_over_time(10m) by (worker)": ("logs", [(1, {"worker": "Ida"}), (6, {})]),
}


@pytest.mark.parametrize("steps", POINTS)
def test_points(catalog, steps):
    source, points = POINTS[steps]
    got = Engine(catalog).query('{service="press"} ' + steps, *HOUR)
    assert got.source == source and [(p["value"], p["by"]) for p in got.points] == [(float(v), by) for v, by in points]
    assert {p["bucket"] for p in got.points} == {START}


def test_limits_and_empty_results(catalog):
    engine = Engine(catalog)
    cut = engine.query('{service="press"}', *HOUR, 3)
    assert cut.truncated and [r["seq"] for r in cut.records] == [32, 31, 30]
    forward = engine.query('{service="press"}', *HOUR, 2, "forward")
    assert [r["seq"] for r in forward.records] == [0, 1]
    none = engine.query('{service="still"}', *HOUR)
    assert none.records == none.points == [] and none.source == "logs" and none.streams == 0 and forward.streams == 1
    body = {"query": '{service="press"} |= "crate 1"', "start": "2025-03-10T00:00:00", "end": "2025-03-10T01:00:00"}
    assert engine.handle(body)["records"][0]["level"] == "info"
    for wrong in ({"direction": "sideways"}, {"start": START, "end": START}, {"limit": -1}):
        with pytest.raises(QueryError):
            engine.query('{service="press"}', **wrong)
    with pytest.raises(QueryError, match="capture group"):
        engine.query('{service="press"} | regexp "(?P<kind>q)" | kilos = "1"', *HOUR)
    with pytest.raises(QueryError, match="bytes"):
        engine.query('{service="' + "p" * 9000 + '"}')


def test_discovery(catalog):
    engine = Engine(catalog)
    assert engine.labels() == ["env", "host", "level", "river", "service"]
    assert engine.label_values("service") == ["mill", "press"] and engine.label_values("river") == ["ilm"]
    assert engine.label_values("level")[-1] == "fatal" and engine.label_values("worker") == []


SOURCES = {
    "": "logs", "| rate(59s)": "logs", "| rate(150s)": "logs", "| rate(60s)": "logs_rate_1m", "| rate(7m)": "logs_rate_1m", "| rate(3h) by (env, level)": "logs_rate_1h",
    "| count_over_time(7d) by (service)": "logs_rate_1h", "| bytes_over_time(2h)": "logs", "!= `q` | rate(2h)": "logs", "| rate(2h) by (kilos)": "logs", "| logfmt | rate(2h)": "logs",
}


@pytest.mark.parametrize("steps", SOURCES)
def test_source(steps):
    assert source_of(parse('{env="farm", level<"fatal"} ' + steps)) == SOURCES[steps]


def test_buckets(spark):
    assert floored(datetime(2000, 1, 4, 1), 7 * 3600) == datetime(2000, 1, 3, 21)
    assert floored(datetime(1999, 12, 31, 23), 7 * 86400) == datetime(1999, 12, 27)
    assert widened(datetime(2025, 3, 9, 7, 1), datetime(2025, 3, 9, 9), 3600) == (datetime(2025, 3, 9, 7), datetime(2025, 3, 9, 9))
    times = [datetime(1995, 3, 4, 5, 6), datetime(2000, 1, 3), datetime(2024, 2, 29, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in times], "time timestamp_ntz")
    for width in (90, 5 * 3600, 7 * 86400):
        assert [r[0] for r in df.select(bucket(df.time, width)).collect()] == [floored(t, width) for t in times]


def test_hostile_values_stay_values(catalog):
    engine = Engine(catalog)
    for text in ("'; DROP TABLE logs; --", "${x}", "`a`", "\\\\", "%' OR '1'='1", "$(x)"):
        literal = '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
        assert engine.query("{service=" + literal + "}", *HOUR).records == []
        assert engine.query('{service="press"} |= ' + literal, *HOUR).records == []


def test_pruning_and_pushdown(spark, tmp_path, catalog):
    path = str(tmp_path / "logs")
    catalog.logs.withColumn("event_date", catalog.logs.time.cast("date")).write.partitionBy("event_date").parquet(path)
    stored = Catalog(catalog.streams, spark.read.parquet(path), None, "event_date")
    plan = compile_query('{service="press", level>="warn"} | count_over_time(1h)', Request(*HOUR), stored)
    text = plan.df._sc._jvm.PythonSQLUtils.explainString(plan.df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(event_date" in text and "GreaterThanOrEqual(level,4)" in text
    assert not any("message" in part.split("\n")[0] for part in text.split("ReadSchema")[1:])
    assert "LeftSemi" in text
    assert [r.value for r in plan.df.collect()] == [1.0]
    assert date(2025, 3, 10).isoformat() in text


#: Streams of a farm, and the messages of each of them.
FARM = [
    (31, "press", "barn-a", "summer", {"river": "ilm", "row": "7"}), (32, "press", "Barn-B", "winter", {"river": "saale"}),
    (33, "press.old", "barn-a", "summer", {}), (34, "well", "yard", "summer", {"river": "", "depth": "12"}),
]
MESSAGES = [(2, "belt 4 oiled"), (3, "Juice at 70% of tank_2"), (6, "Belt torn: stop"), (4, "tank\n  leak near valve\n  9 litres"), (5, "no belt")]
#: Selectors with the streams they match, and queries with the messages.
STREAM_CASES = {
    'service="press"': {31, 32}, 'service!="press"': {33, 34}, 'service=~"press|well"': {31, 32, 34}, 'service=~"ress"': set(), 'service=~"press.*"': {31, 32, 33}, 'service!~".*l.*"': {31, 32},
    'host=~"(?i)BARN-."': {31, 32, 33}, 'host>"barn-a"': {34}, 'host<"a"': {32}, 'host>="barn-a", host<="barn-a"': {31, 33}, 'river="saale"': {32}, 'river=""': {34}, 'river!=""': {31, 32},
    'river!~"i.*"': {32, 33, 34}, 'river=~".?"': {33, 34}, 'river<="ilm"': {31, 33, 34}, 'river>"ilm"': {32}, 'row!="7"': {32, 33, 34}, 'depth="12", env="summer"': {34}, 'depth=~"1.", env="winter"': set(),
}
RECORD_CASES = {
    "{env=~`.+`} |= `BELT`": {0, 2, 4}, "{env=~`.+`} != `belt`": {1, 3}, "{env=~`.+`} |= `70%`": {1}, "{env=~`.+`} |= `k_2`": {1}, "{env=~`.+`} |= `k%2`": set(),
    "{env=~`.+`} |~ `tank.+litres`": {3}, "{env=~`.+`} |~ `^  9`": set(), "{env=~`.+`} |~ `(?m)^  9`": {3}, "{env=~`.+`} |~ `(?i)^BELT`": {0, 2}, "{env=~`.+`} !~ `[0-9]`": {2, 4},
    "{level>`warn`}": {2, 4}, "{level=`dbg`} |= `oil`": {0}, "{level!=`fatal`, level>=`info`} |= `tank`": {1, 3},
}


@pytest.fixture(scope="module")
def farm(spark):
    streams = spark.createDataFrame(FARM, STREAMS)
    logs = spark.createDataFrame([log(s[0], k, 3 * k, number, m) for s in FARM for k, (number, m) in enumerate(MESSAGES)], LOGS)
    flat = logs.join(streams, "stream_id").persist()
    return Catalog(streams, logs), flat


@pytest.mark.parametrize("selector", STREAM_CASES)
def test_streams_alike_in_query_and_tail(farm, selector):
    catalog, flat = farm
    text = "{" + selector + "}"
    got = compile_query(text, Request(*HOUR, None), catalog).df
    assert {r.stream_id for r in got.select("stream_id").distinct().collect()} == STREAM_CASES[selector]
    assert {r.stream_id for r in tail.tailed(text, flat).select("stream_id").distinct().collect()} == STREAM_CASES[selector]


@pytest.mark.parametrize("text", RECORD_CASES)
def test_records_alike_in_query_and_tail(farm, text):
    catalog, flat = farm
    got = compile_query(text, Request(*HOUR, None), catalog).df
    assert {r.seq for r in got.collect()} == RECORD_CASES[text] and got.count() == len(FARM) * len(RECORD_CASES[text])
    assert {r.seq for r in tail.tailed(text, flat).collect()} == RECORD_CASES[text]


def test_tail_refuses(farm):
    for steps, message in (
        ("| logfmt", "1:17: tail supports selectors and line filters; | logfmt needs query"),
        ("| kilos < 3", "1:17: tail supports selectors and line filters; label filter | kilos needs query"),
        ("| rate(1h)", "1:17: tail cannot aggregate; use query"),
    ):
        with pytest.raises(QueryError) as wrong:
            tail.tailed("{river=`ilm`}" + " " + steps, farm[1])
        assert str(wrong.value) == message
