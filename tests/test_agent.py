"""Files to stored records, tails of what is accepted, and the command line."""

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog import __main__ as cli
from emberlog.engine import Engine
from emberlog.operators import report, storage
from emberlog.plans.ast import QueryError
from emberlog.plans.compiler import Catalog
from emberlog.sources import follow, lines
from emberlog.streaming import ingest, rates, tail

NOW = datetime(2025, 6, 2, 9)
SCHEMA = "time timestamp, seq long, level short, message string, service string, host string, env string, labels map<string,string>, trace_id binary, span_id binary, fields map<string,string>"


def record(seq, seconds=0, message=None, service="well", level=3):
    return (NOW - timedelta(minutes=40) + timedelta(seconds=seconds), seq, level, message or f"bucket {seq}", service, "yard", "farm", {}, None, None, {})


def taken(spark, folder, pattern="*.log*"):
    """What one more run of the stream reads, with the checkpoint of the run before."""
    rows = []
    stream = lines.stream_lines(spark, f"{folder}/{pattern}")
    writer = stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect()))
    query = writer.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((r.start, r.offset, r.line) for r in rows)


def test_follows_growth_rotation_and_truncation(spark, tmp_path):
    log = tmp_path / "well.log"
    log.write_bytes(b"one\ntwo\r\nthr")
    assert taken(spark, tmp_path) == [(0, 4, "one"), (4, 9, "two")]  # the last line isn't whole
    with log.open("ab") as f:
        f.write("ee\nvier ü\n".encode())
    assert taken(spark, tmp_path) == [(9, 15, "three"), (15, 23, "vier ü")]
    with log.open("ab") as f:
        f.write(b"last\n")
    log.rename(tmp_path / "well.log.1")
    log.write_bytes(b"new file\n")
    assert taken(spark, tmp_path) == [(0, 9, "new file"), (23, 28, "last")]
    with log.open("r+b") as f:  # truncated in place and written again
        f.truncate(0)
        f.write(b"x\ny\n")
    assert taken(spark, tmp_path) == [(0, 2, "x"), (2, 4, "y")]
    assert taken(spark, tmp_path) == []


def test_pieces_join_to_all_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "PIECE", 50)
    path = tmp_path / "a.log"
    texts = ["x" * (k % 90) for k in range(200)]
    path.write_text("\n".join(texts) + "\n")
    reader = follow.FollowReader({"path": str(path)})
    end = reader.latestOffset()
    pieces = reader.partitions({}, end)
    assert len(pieces) > 100
    got = [row for p in pieces for row in reader.read(p)]
    assert [r[5] for r in got] == texts and [r[3] for r in got] == [0, *[r[4] for r in got]][:-1]
    assert reader.partitions(end, reader.latestOffset()) == []


def test_long_lines(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"h\n" + "é".encode() * 40_000 + b"\nend\n" + b"z" * 70_000)
    reader = follow.FollowReader({"path": str(path)})
    got = [row for p in reader.partitions({}, reader.latestOffset()) for row in reader.read(p)]
    assert [len(r[5].encode()) for r in got] == [1, 65536, 3, 65536]
    assert [r[4] for r in got] == [2, 80_003, 80_007, 150_007]  # what is over counts in the offset


def test_files_to_store(spark, tmp_path):
    (tmp_path / "well.log").write_text('{"level":"warn","depth":7}\nplain\n{"app":"pump","level":"nope"}\n')
    store = ingest.Store(str(tmp_path / "store"))
    rows = lines.records(lines.stream_lines(spark, f"{tmp_path}/*.log"), "yard", "farm", service_field="app", labels={"river": "ilm"})
    counters = report.Counters()
    ingest.start(rows, store, str(tmp_path / "ckpt"), once=True, told=counters.add).awaitTermination(120)
    counters.add({"received": 3, "written": 0, "deduped": 1, "rejected": 2, "reasons": {"time too old": 2}})
    assert counters.totals == {"received": 6, "written": 3, "deduped": 1, "rejected": 2}
    assert 'emberlog_records_rejected_total{reason="time too old"} 2' in counters.exposed().splitlines()
    found = ingest.catalog(spark, store)
    got = found.logs.join(found.streams.select("stream_id", "service", "labels"), "stream_id").orderBy("seq").collect()
    assert [(r.seq, r.level, r.service, r.labels) for r in got] == [(0, 4, "well", {"river": "ilm"}), (27, 0, "well", {"river": "ilm"}), (33, 0, "pump", {"river": "ilm"})]
    assert got[0].fields == {"level": "warn", "depth": "7"} and got[1].fields is None


def test_tails_hear_what_is_accepted(spark, tmp_path):
    hub, store = tail.Hub(), ingest.Store(str(tmp_path / "store"))
    wide, narrow = hub.subscribe('{service="well"}', 2), hub.subscribe('{level>="warn"} |= "bucket"')
    with pytest.raises(QueryError):
        hub.subscribe('{service="well"} | json')
    rows = [record(k, k) for k in range(5)] + [record(9, 9, level=5), record(10, 10, service=""), record(11, 10, service="mill")]
    ingest.write_batch(spark.createDataFrame(rows, SCHEMA), store, NOW, tails=hub)
    assert [r.seq for r in narrow.drain()] == [9]
    assert wide.take(0)[0].seq == 0 and wide.dropped == 4
    ingest.write_batch(spark.createDataFrame([record(20, 20)], SCHEMA), store, NOW, tails=hub)
    assert [(r.seq, lost) for r, lost in (wide.take(0), wide.take(0))] == [(1, 0), (20, 0)] and wide.take(0) is None
    hub.leave(wide)
    ingest.write_batch(spark.createDataFrame([record(21, 21)], SCHEMA), store, NOW, tails=hub)
    assert wide.take(0) is None


def test_losses_are_told_with_the_next_record():
    reader = tail.Subscriber(1)
    for k in range(3):
        reader.offer(k)
    assert reader.take(0) == (0, 2)
    reader.offer(7)
    assert reader.take(0) == (7, 0)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = ingest.Store(str(tmp_path_factory.mktemp("farm") / "store"))
    rows = [record(k, 2 * k, f"bucket {k}" + (" cracked" if k % 400 == 7 else "")) for k in range(1000)]
    ingest.write_batch(spark.createDataFrame(rows, SCHEMA), store, NOW)
    return store


@pytest.mark.parametrize("forward", [False, True])
def test_newest_first_reads_no_more_than_it_needs(spark, stored, forward, monkeypatch):
    asked = []
    engine = Engine(ingest.catalog(spark, stored))
    from emberlog import engine as module

    compile_query = module.compile_query
    monkeypatch.setattr(module, "compile_query", lambda q, request, catalog: asked.append(request) or compile_query(q, request, catalog))
    direction = "forward" if forward else "backward"
    span = (NOW - timedelta(days=3), NOW + timedelta(days=1))
    got = engine.query('{service="well"} |= "bucket"', *span, 20, direction)
    assert [r["seq"] for r in got.records] == (list(range(20)) if forward else list(range(999, 979, -1))) and got.truncated
    assert sum((r.end - r.start).total_seconds() for r in asked[1:]) < 1200
    rare = engine.query('{service="well"} |= "cracked"', *span, 20, direction)
    assert [r["seq"] for r in rare.records] == ([7, 407, 807] if forward else [807, 407, 7]) and not rare.truncated
    assert engine.query('{service="well"} |= "gold"', *span, 20, direction).records == []


def test_requests_as_text(spark, stored):
    engine = Engine(ingest.catalog(spark, stored))
    body = {"query": '{service="well"} |= "bucket 3"', "start": "2025-06-02T08:00:00Z", "end": "2025-06-02T10:00:00Z", "limit": 2}
    assert len(engine.handle(json.dumps(body))["records"]) == 2
    with pytest.raises(QueryError, match="max 65536"):
        engine.handle(json.dumps(body | {"note": "x" * 70_000}))
    with pytest.raises(QueryError, match="object"):
        engine.handle("[]")


def test_command_line(spark, stored):
    now = NOW.replace(tzinfo=UTC)
    run = lambda *args: cli.run(spark, cli.parsed([stored.root, *args]), now)
    out = run("query", '{service="well"} |= "cracked"', "--since", "1h", "--limit", "2")
    assert len(out) == 3 and "bucket 807 cracked" in out[0] and out[2] == "... more records match"
    assert json.loads(run("query", '{service="well"} | count_over_time(1d)', "--json")[0])["value"] == 1000.0
    assert run("labels", "service") == ["well"] and run("compact") and any(x.startswith("ratio") for x in run("stats"))
    assert cli.moment("15m", now) == now - timedelta(minutes=15) and cli.moment("2025-06-02T09:00:00", now) == now


def test_rates_ignore_times_that_are_refused(spark, tmp_path):
    source = str(tmp_path / "in")
    early = (datetime(2099, 1, 1), *record(0)[1:])
    for rows in ([record(0), early], [record(1, 1), record(2, 61)]):
        spark.createDataFrame(rows, SCHEMA).withColumn("stream_id", F.lit(1).cast("long")).coalesce(1).write.mode("append").parquet(source)
        stream = rates.per_minute(spark.readStream.schema(SCHEMA + ", stream_id long").parquet(source), F.lit(NOW).cast("timestamp"))
        out = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        out.awaitTermination(60)
        assert out.exception() is None
    assert out.lastProgress["stateOperators"][0]["numRowsDroppedByWatermark"] == 0


def test_container_lines(spark):
    rows = spark.createDataFrame([("2025-06-02T09:00:00.123456789Z up", None, 5), ("no time", NOW, 6), ("2025-06-02T09:00:00Z", NOW, 7)], "line string, time timestamp, start long")
    got = lines.container_lines(rows, F.lit("pump"), F.lit("stdout")).collect()
    assert [(r.line, r.start, r.service) for r in got] == [("up", 1748854800123456789, "pump-stdout"), ("no time", 6, "pump-stdout"), ("2025-06-02T09:00:00Z", 7, "pump-stdout")]


def test_levels_trim_all_white_space(spark):
    from emberlog.plans import levels

    texts = ["\twarn\n", " ERR ", "info", " x ", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(levels.number_column(F.col("t"))).collect()] == [levels.number(t or "") or 0 for t in texts] == [4, 5, 3, 0, 0, 0]


def test_walk_without_times_of_streams(spark):
    streams = spark.createDataFrame([(1, "well", "yard", "farm", {})], "stream_id long, service string, host string, env string, labels map<string,string>")
    logs = spark.createDataFrame([(NOW, 1, k, 3, "m", None, None, None) for k in range(3)], "time timestamp, stream_id long, seq long, level short, message string, trace_id binary, span_id binary, fields map<string,string>")
    got = Engine(Catalog(streams, logs)).query('{service="well"}', NOW - timedelta(days=90), NOW + timedelta(hours=5), 9)
    assert [r["seq"] for r in got.records] == [2, 1, 0]
    assert storage.REFRESH == timedelta(minutes=1)
