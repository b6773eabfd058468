import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import fingerprint
from emberlog.functions.extract import number_compared
from emberlog.functions.ingest_fields import cut, extracted, fields, json_pairs
from emberlog.operators import multiline as batch_multiline
from emberlog.operators import report, storage
from emberlog.plans.compiler import Request, compile_query
from emberlog.sources import lines, synthetic
from emberlog.streaming import ingest, multiline, rates, tail

NOW = datetime(2026, 9, 1, 12)
REASONS = dict.fromkeys(("missing label service", "invalid level", "time in the future", "field value too long"), 1)
SCHEMA = "time timestamp, seq long, level short, message string, service string, host string, env string, labels map<string,string>, trace_id binary, span_id binary, fields map<string,string>"


def row(seq, seconds=0, **other):
    base = {"time": NOW - timedelta(minutes=30) + timedelta(seconds=seconds), "seq": seq, "level": 3, "message": f"m {seq}", "service": "api", "host": "h", "env": "prod", "labels": {}, "trace_id": None, "span_id": None, "fields": {}}
    return tuple((base | other).values())


def test_xxh64_and_encoding():
    assert fingerprint.xxh64(b"") == 0xEF46DB3751D8E999
    xxhash = pytest.importorskip("xxhash")
    r = random.Random(1)
    for n in (1, 3, 4, 7, 8, 20, 31, 32, 33, 100, 1000):
        data = r.randbytes(n)
        assert fingerprint.xxh64(data) == xxhash.xxh64_intdigest(data)
    sets = [("a", "b|c", "d", {}), ("a|b", "c", "d", {}), ("a", "b", "cd", {}), ("a", "b", "c", {"d": ""}), ("a", "b", "c", {"x": "yz"}), ("a", "b", "c", {"xy": "z"}), ("a", "b", "c", {"é" * 70: "1"})]
    assert len({fingerprint.encoded(*s) for s in sets}) == len(sets)
    assert fingerprint.encoded("a", "b", "c", {"z": "1", "y": "2"}) == fingerprint.encoded("a", "b", "c", {"y": "2", "z": "1"})


def test_json_fields():
    assert dict(json_pairs('{"s":"x","i":7,"f":1.50,"e":1e2,"b":true,"n":null,"a":[1, 2],"o":{"k": "v"},"i":8} junk')) == {
        "s": "x", "i": "8", "f": "1.50", "e": "1e2", "b": "true", "n": "null", "a": "[1,2]", "o": '{"k":"v"}',
    }
    assert [json_pairs(x) for x in ("", "[1]", '"x"', "5", "{bad", '{"a":1,}', '{"a":NaN}')] == [[]] * 7
    assert cut("é" * 5000) == "é" * 4096
    assert fields('{"a\\ud800":"x\\udc00y","b":["\\ud83d\\ude00","\\ud83d"]}') == {"a\ufffd": "x\ufffdy", "b": '["\U0001f600","\ufffd"]'}
    many = fields('{"": "x", "%s": "y", %s}' % ("n" * 129, ",".join(f'"k{i}": {i}' for i in range(70))))
    assert len(many) == 64 and "" not in many


def test_extracted(spark):
    df = spark.createDataFrame([("42 info",), ('{"level":"warn"} 7',), (None,), ("zz",)], "line string")
    got = [r[0] for r in df.select(extracted(F.col("line"), True, r"(?<n>\d+) ?(?P<level>info)?(?P<no>zzz)?")).collect()]
    assert got == [{"n": "42", "level": "info"}, {"level": "warn", "n": "7"}, None, None]
    with pytest.raises(ValueError):
        extracted(F.col("line"), True, "(x)")


def test_number_guard(spark):
    cases = [("1d", False), ("NaN", False), ("inf", False), ("", False), (None, False), ("5", False), (" 5.5 ", True), ("1e3", True), ("0x1F", False), ("99999999999999999999999999", True), ("-7", False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string")
    got = [bool(r[0]) for r in df.select(number_compared(F.col("v"), ">", "5")).collect()]
    assert got == [c[1] for c in cases]


def test_write_batch(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "store"))
    first = spark.createDataFrame([row(k, k) for k in range(100)] + [row(200, service=""), row(201, level=9), row(202, time=NOW + timedelta(hours=1)), row(203, fields={"x": "y" * 9000})], SCHEMA)
    assert ingest.write_batch(first, store, NOW) == {"received": 104, "rejected": 4, "deduped": 0, "written": 100, "reasons": REASONS}
    assert ingest.write_batch(first, store, NOW) == {"received": 104, "rejected": 4, "deduped": 100, "written": 0, "reasons": REASONS}
    second = spark.createDataFrame([row(k, k) for k in range(50, 150)] + [row(7, 7, service="web", labels={"region": "eu"})], SCHEMA)
    assert ingest.write_batch(second, store, NOW) == {"received": 101, "rejected": 0, "deduped": 50, "written": 51, "reasons": {}}
    assert {r.reason for r in spark.read.parquet(store.rejected).collect()} == {"missing label service", "invalid level", "time in the future", "field value too long"}
    catalog = ingest.catalog(spark, store)
    assert catalog.streams.count() == 2
    assert {r.stream_id for r in catalog.streams.where("service = 'web'").collect()} == {fingerprint.stream_id("web", "h", "prod", {"region": "eu"})}
    for name in ("logs_rate_1m", "logs_rate_1h"):
        assert catalog.rollups[name].agg(F.sum("n")).first()[0] == 151
    span = Request(NOW - timedelta(hours=1), NOW + timedelta(hours=1))
    plan = compile_query('{service="api"} | count_over_time(1h)', span, catalog)
    assert plan.source == "logs_rate_1h" and [r.value for r in plan.df.collect()] == [150.0]
    plain = compile_query('{service="api"} |= "m" | count_over_time(1h)', span, catalog)
    assert plain.source == "logs" and [r.value for r in plain.df.collect()] == [150.0]
    stats = storage.statistics(spark, store.logs)
    assert stats["ratio"] > 0
    day = (NOW - timedelta(minutes=30)).date().isoformat()
    before = sorted(map(str, spark.read.parquet(store.logs).collect()))
    assert storage.compact(spark, store.logs, NOW) == [] and storage.compact(spark, store.logs, NOW + timedelta(days=1)) == [day]
    assert sorted(map(str, spark.read.parquet(store.logs).collect())) == before
    assert storage.drop_old_partitions(spark, store.logs, NOW + timedelta(days=40)) == [(NOW - timedelta(minutes=30)).date().isoformat()]


def test_stream_restarts(spark, tmp_path):
    store, source = ingest.Store(str(tmp_path / "store")), str(tmp_path / "in")
    spark.createDataFrame([row(k, k) for k in range(20)], SCHEMA).write.mode("append").parquet(source)

    def run(checkpoint):
        records = ingest.keyed(spark.readStream.schema(SCHEMA).parquet(source))
        query = ingest.start(records, store, str(tmp_path / checkpoint), NOW, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.read.parquet(store.logs).count()

    assert run("c1") == 20
    spark.createDataFrame([row(k, k) for k in range(10, 30)], SCHEMA).write.mode("append").parquet(source)
    assert run("c1") == 30
    assert run("lost") == 30  # all is read again, nothing is stored again


def test_stream_judges_times_itself(spark, tmp_path):
    """A refused time in the future drops no record of later batches; a late one is told as rejected."""
    store, source = ingest.Store(str(tmp_path / "store")), str(tmp_path / "in")
    batches = [[row(0), row(1, time=datetime(2099, 1, 1))], [row(2)], [row(3), row(4, time=NOW - timedelta(days=8)), row(0)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        records = ingest.keyed(spark.readStream.schema(SCHEMA).parquet(source))
        query = ingest.start(records, store, str(tmp_path / "c"), NOW, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.seq for r in spark.read.parquet(store.logs).collect()) == [0, 2, 3]
    assert {(r.seq, r.reason) for r in spark.read.parquet(store.rejected).collect()} == {(1, "time in the future"), (4, "time too old")}


def test_lines_are_numbered_by_byte_offset(spark, tmp_path):
    """More than 2^20 short lines in a split, and the same numbers however files are split and packed."""
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.log").write_bytes(b"x\n" * ((1 << 20) + 5))
    many = lines.text_lines(spark, f"file://{tmp_path}/many")
    assert many.agg(F.count("*"), F.count_distinct("seq"), F.max("seq")).first()[:] == ((1 << 20) + 5, (1 << 20) + 5, 2 * (1 << 20) + 8)
    r = random.Random(3)
    want = set()
    (tmp_path / "some").mkdir()
    for name in ("b.log", "c.log", "d.log"):
        texts = ["é" * r.randint(0, 9) + r.choice(["", "\r", "a\rb"]) for _ in range(400)]
        data, at = "\n".join(texts).encode(), 0
        (tmp_path / "some" / name).write_bytes(data)
        for k, t in enumerate(texts):
            if k < len(texts) - 1 or t:
                want.add((name, at, t.removesuffix("\r")))
            at += len(t.encode()) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = lines.text_lines(spark, f"file://{tmp_path}/some").collect()
            assert len(got) == len(want) and {(x.source.rpartition("/")[2], x.seq, x.line) for x in got} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def state(spark, store):
    """All that a store tells: records, streams and counts."""
    catalog = ingest.catalog(spark, store)
    rates = [sorted((str(r.bucket), r.stream_id, r.level, r.n) for r in catalog.rollups[n].groupBy("bucket", "stream_id", "level").agg(F.sum("n").alias("n")).where("n <> 0").collect()) for n in sorted(catalog.rollups)]
    logs = sorted((r.stream_id, r.seq, r.message) for r in catalog.logs.collect())
    return logs, sorted((r.stream_id, str(r.first_seen), str(r.last_seen)) for r in catalog.streams.collect()), rates


class Stopped(Exception):
    pass


def stopper(*at):
    """Raises at the n-th step of a name."""
    seen = []

    def stop(step):
        seen.append(step)
        if (step, seen.count(step)) in at:
            raise Stopped(step)

    return stop


def test_stops_lose_and_double_nothing(spark, tmp_path):
    first = spark.createDataFrame([row(k, k * 70) for k in range(20)], SCHEMA)
    second = spark.createDataFrame([row(k, k * 70) for k in range(10, 30)] + [row(5, 0, service="web")], SCHEMA)
    whole = ingest.Store(str(tmp_path / "whole"))
    for batch in (first, second):
        ingest.write_batch(batch, whole, NOW)
    want = state(spark, whole)
    for step in ("streams", "noted", "logs", "minutes"):
        store = ingest.Store(str(tmp_path / step))
        ingest.write_batch(first, store, NOW)
        with pytest.raises(Stopped):
            ingest.write_batch(second, store, NOW, stop=stopper((step, 1)))
        ingest.write_batch(second, store, NOW)
        assert state(spark, store) == want, step


def test_compaction_stops_anywhere(spark, tmp_path):
    """Killed at any step, and with late records of the day before it goes on: nothing is lost, nothing is doubled."""
    for n, at in enumerate((("written", 1), ("listed", 1), ("moved", 1), ("deleted", 1), ("deleted", 2))):
        path = str(tmp_path / f"logs{n}")
        for part in range(3):
            storage.append_logs(spark.createDataFrame([row(part * 10 + k, k) for k in range(10)], SCHEMA).withColumn("stream_id", F.lit(1).cast("long")), path)
        with pytest.raises(Stopped):
            storage.compact(spark, path, NOW + timedelta(days=1), stop=stopper(at))
        assert {r.seq for r in spark.read.parquet(path).collect()} == set(range(30))
        storage.append_logs(spark.createDataFrame([row(99, 5)], SCHEMA).withColumn("stream_id", F.lit(1).cast("long")), path)
        storage.compact(spark, path, NOW + timedelta(days=1))
        got = [r.seq for r in spark.read.parquet(path).collect()]
        assert sorted(got) == [*range(30), 99]
        assert storage.compact(spark, path, NOW + timedelta(days=1)) == []


def test_compacted_store_answers_alike(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "store"))
    for part in range(3):
        ingest.write_batch(spark.createDataFrame([row(part * 10 + k, part * 120 + k) for k in range(15)], SCHEMA), store, NOW)
    before = state(spark, store)
    done = ingest.compact(spark, store, NOW + timedelta(days=1))
    assert set(done) == {"logs", "logs_rate_1m", "logs_rate_1h"} and all(done.values())
    assert state(spark, store) == before
    assert spark.read.parquet(store.streams).count() == 1


def test_first_writer_wins(spark):
    rows = spark.createDataFrame([(1, 7, NOW, m, {"a": m}, k) for k, m in enumerate(["first", "second", "third"])], "stream_id long, seq long, time timestamp, message string, fields map<string,string>, arrival long")
    assert [r.message for r in storage.first_of_each(rows.repartition(3), F.col("arrival")).collect()] == ["first"]
    again = {storage.first_of_each(rows.drop("arrival").repartition(n)).first().message for n in (1, 2, 3)}
    assert len(again) == 1


def test_streams_are_stored_when_they_tell_something_new(spark):
    kind = "stream_id long, service string, host string, env string, labels map<string,string>, first_seen timestamp, last_seen timestamp"
    at = lambda s: NOW + timedelta(seconds=s)
    stored = spark.createDataFrame([(k, "s", "h", "e", {}, at(0), at(100)) for k in range(4)], kind)
    seen = spark.createDataFrame([(0, "s", "h", "e", {}, at(5), at(159)), (1, "s", "h", "e", {}, at(5), at(160)), (2, "s", "h", "e", {}, at(-1), at(3)), (9, "s", "h", "e", {}, at(5), at(5))], kind)
    assert {r.stream_id for r in storage.fresh_streams(seen, stored).collect()} == {1, 2, 9}


def test_tail_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([row(k, k) for k in range(30)], SCHEMA).write.parquet(source)
    reader = tail.Subscriber(5)
    tail.start('{service="api"} |= "m 1"', spark.readStream.schema(SCHEMA).parquet(source), reader, once=True).awaitTermination(60)
    assert [r.seq for r in reader.drain()] == [1, 10, 11, 12, 13] and reader.dropped == 6


def test_rate_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([row(k, k * 10) for k in range(30)], SCHEMA).withColumn("stream_id", F.lit(1).cast("long")).write.parquet(source)
    stream = rates.per_minute(spark.readStream.schema(SCHEMA + ", stream_id long").parquet(source), F.lit(NOW).cast("timestamp"))
    query = stream.writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("rates").agg(F.sum("n"), F.count("*")).first()[:] == (30, 5)


def test_multiline_rules():
    import re

    at = re.compile(r"^\s+at ")
    open_, out = None, []
    for k, x in enumerate(["E one", "  at a", "  at b", "other", "  at c"] + ["  at x"] * 600 + ["  at " + "y" * 70000]):
        done, open_ = multiline.absorb(open_, (k, k, k + 1, 1, x), at)
        out += [done] if done else []
    assert out[0] == (0, 0, 3, 3, "E one\n  at a\n  at b") and out[1][3] == 500
    assert open_[4].startswith("  at yyy") and open_[3] == 1


def test_multiline_batch(spark):
    rows = [("a", 0, "E one"), ("b", 0, "  at first"), ("a", 1, "  at x"), ("a", 2, "next"), ("b", 1, "  at y")]
    df = spark.createDataFrame(rows, "source string, start long, line string")
    got = {(r.source, r.start, r.last, r.lines, r.text) for r in batch_multiline.joined(df, F.col("line").rlike(r"^\s+at ")).collect()}
    assert got == {("a", 0, 1, 2, "E one\n  at x"), ("a", 2, 2, 1, "next"), ("b", 0, 1, 2, "  at first\n  at y")}


def test_multiline_in_chunks(spark):
    r = random.Random(11)
    rows = [(s, at, r.choice(["E", "  at x", "  at y", "next"]) + str(at)) for s in ("a", "b", "c") for at in sorted(r.sample(range(500), 90))]
    rows += [("d", at, f"  at {at}") for at in range(0, 300, 7)]
    df = spark.createDataFrame(rows, "source string, start long, line string")
    run = lambda chunk: sorted(map(tuple, batch_multiline.joined(df, F.col("line").rlike(r"^\s+at "), chunk=chunk).collect()))
    assert len(run(None)) > 50 and run(None) == run(1) == run(13) == run(10_000)
    assert [x[:4] for x in run(None) if x[0] == "d"] == [("d", 0, 294, 43)]


def test_multiline_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "source string, time timestamp, start long, offset long, line string"
    rows = [("a", NOW, 0, 5, "E one"), ("a", NOW, 5, 12, "  at x"), ("a", NOW, 12, 17, "E two")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = multiline.joined(spark.readStream.schema(schema).parquet(source), r"^\s+at ", idle_ms=1000)
    query = stream.writeStream.format("memory").queryName("joined").outputMode("append").start()
    try:
        for _ in range(40):  # the idle record is flushed by a timer
            if spark.table("joined").count() == 2:
                break
            time.sleep(0.5)
        assert {(r.start, r.offset, r.lines, r.line) for r in spark.table("joined").collect()} == {(0, 12, 2, "E one\n  at x"), (12, 17, 1, "E two")}
    finally:
        query.stop()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z hello  there",), ("2024-01-02T03:04:05+01:00 x",), ("no time",), ("2024-13-02T03:04:05Z y",)], "raw string")
    t, m = lines.container_split(F.col("raw"))
    got = df.select(t.cast("string"), m).collect()
    assert [tuple(r) for r in got] == [("2024-01-02 03:04:05.123456", "hello  there"), ("2024-01-02 02:04:05", "x"), (None, "no time"), (None, "2024-13-02T03:04:05Z y")]
    texts = spark.createDataFrame([("x\r",), ("é" * 40000,), ("a.b c>é" * 20,), ("",), ("/var/log/app.1.log",)], "v string")
    got = [tuple(r) for r in texts.select(F.octet_length(lines.assembled(F.col("v"))), lines.routing_token(F.col("v")), lines.service_of(F.col("v"))).collect()]
    assert got[0][0] == 1 and got[1][0] == 65536 and len(got[2][1]) == 64 and got[2][1].startswith("a_b_c___a") and got[3][1] == "_" and got[4][2] == "app.1"
    (tmp_path / "svc.log").write_text("one\ntwo\r\nthree")
    read = [lines.text_lines(spark, f"file://{tmp_path}/svc.log").orderBy("seq").collect() for _ in range(2)]
    assert read[0] == read[1] and [r.line for r in read[0]] == ["one", "two", "three"]
    sent = lines.manual(spark, ["a", "b"], "s", "h", "e", "WARN", NOW).collect()
    assert [(r.seq, r.level) for r in sent] == [(0, 4), (1, 4)]


def test_synthetic(spark):
    a = synthetic.records(spark, 5000).orderBy("seq").collect()
    assert a == synthetic.records(spark, 5000).repartition(7).orderBy("seq").collect()
    assert {len(r.message) for r in a} == {200} and a[501].service == "loadgen-svc-1"
    common, rare = (sum(w in r.message.split() for r in a) for w in ("request", "corrupt"))
    assert common > 3 * rare > 0
    times = [spark.range(1).select(synthetic.release_at(F.lit(n), 100.0, 10.0)).first()[0] for n in (0, 125, 500, 1500)]
    assert times == [0.0, 5.0, 10.0, 20.0]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 9, 3, 3, 3, 7, 2, 2]] + [(None,)], "v double")
    assert {r.p: r.value for r in report.nearest_rank(df, "v", [0.1, 0.5, 0.95, 1.0]).collect()} == {0.1: 1.0, 0.5: 3.0, 0.95: 9.0, 1.0: 9.0}
    assert report.nearest_rank(df.limit(0), "v", [0.5]).count() == 0
