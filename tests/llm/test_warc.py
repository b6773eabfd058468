import gzip
import hashlib
import io
import random

import pytest

from emberlog.llm import warc


def test_framing():
    for payload in (b"", b"x", b"a\r\n0\r\n\r\nb" * 50, bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(payload, 17)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_records_stream():
    members = warc.page_records("urn:page:1:0", "http://x/ü", b"payload" * 3000, 21000, "d", None, 500) + warc.page_records("urn:page:2:1", None, b"", 0, "e", None)
    data = b"".join(members)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(members)
    got = list(warc.records(io.BytesIO(data)))
    assert len(got) == len(members) and got[-1][0]["warc-type"] == "response"
    assert got[1][0]["warc-type"] == "continuation" and got[1][0]["warc-segment-number"] == "2"
    assert b"".join(b for _, b in got[:-1])[len(warc.HTTP) :] == warc.chunked(b"payload" * 3000)


def expected(rows):
    out, first = [], {}
    for n, (i, _, html) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= 100:
            key = (2**63 if i is None else i, n)
            first[body] = min(first.get(body, key), key)
    for n, (i, _, html) in enumerate(rows):
        body = (html or "").encode()
        origin = first.get(body)
        revisit = origin is not None and origin[1] != n
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", (origin[0] if origin[0] < 2**63 else None) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    r = random.Random(1)
    page = lambda n: "".join(r.choice("<>abcü \r\n") for _ in range(n))
    rows = [(k, f"http://h/{k}", page(r.choice([0, 5, 99, 100, 3000, 200_000]))) for k in range(40)]
    rows += [(100 + k, None, rows[k % 4][2]) for k in range(20)] + [(200, "u", None), (201, "u", ""), (None, "u", "q" * 300), (7, "again", rows[7][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.round_trip(df, segment=20_000)
    assert sorted((tuple(x)[:5] for x in got.collect()), key=str) == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_missing_segment(spark):
    schema = warc.RECORD
    rows = [("a", 1, "response", None, "d", None, None, 1, b"xx"), ("a", 1, "continuation", None, "", None, 9, 3, b"yy")]
    with pytest.raises(Exception, match="add up"):
        warc.assembled(spark.createDataFrame(rows, schema)).collect()


def test_equal_rows_nulls_and_clashing_columns(spark):
    """Of equal rows one is the response; extra columns with names of our own don't matter."""
    body = "z" * 150
    rows = [(3, "u", body)] * 4 + [(None, "u", body)] * 2 + [(None, None, None)] * 2 + [(5, "u", "small")] * 3 + [(3, "t", body), (9, "w", "w" * 400_000)]
    clash = "page_id long, url string, html string, page string, digest string, copy int, leads boolean, size int"
    df = spark.createDataFrame([(*x, "p", "d", 7, True, 1) for x in rows], clash).repartition(3)
    got = sorted((tuple(x)[:5] for x in warc.round_trip(df).collect()), key=str)
    assert sorted((x[0], x[3], x[4]) for x in got if x[1] == 150 and x[0]) == [(3, "response", None)] + [(3, "revisit", 3)] * 4
    assert [(x[3], x[4]) for x in got if x[1] == 150 and x[0] is None] == [("revisit", 3)] * 2
    assert sorted((x[0] or 0, x[1], x[3]) for x in got if x[1] != 150) == [(0, 0, "response")] * 2 + [(5, 5, "response")] * 3 + [(9, 400_000, "response")]
