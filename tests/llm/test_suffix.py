import hashlib
import random
from collections import Counter

import numpy as np

from emberlog.llm import suffix


def brute(rows, length=200):
    seen = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.r_[False, gone]) & gone).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéßü") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(60), prose(150)
    docs = [prose(r.randint(1, 150)) for _ in range(20)]
    docs += [base, base, base[:400] + " changed " + base[400:], base[7:], prose(30) + shared + prose(20), shared + prose(9), prose(4) + shared]
    docs += ["ab" * 400, "x" * 199, "x" * 200, "x" * 201, "y" * 200, "", None, "é" * 150, "aé" + "é" * 120, prose(40) * 3]
    return [(i, d) for i, d in enumerate(docs)] + [(3, docs[3])]


def test_bucket_pointers_sort_suffixes():
    r = np.random.default_rng(0)
    data = r.integers(97, 100, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    starts = np.arange(len(data) - 50)
    got = suffix.bucket_pointers(data, 50, starts)
    raw = bytes(data)
    want = sorted(starts, key=lambda i: raw[i : i + 50])
    place = {}
    for k, i in enumerate(want):
        place.setdefault(raw[i : i + 50], k)
    assert (got[np.argsort([place[raw[i : i + 50]] for i in starts], kind="stable")][1:] >= got[np.argsort([place[raw[i : i + 50]] for i in starts], kind="stable")][:-1]).all()
    assert all((got[i] == got[j]) == (raw[i : i + 50] == raw[j : j + 50]) for i, j in [(200, 1000), (210, 1010), (0, 1), (349, 1149), (551, 1351)])


def check(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.span_digest(suffix.suffix_dedup(df)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_like_brute_force(spark):
    check(spark, corpus())


def test_large_keys_and_small_lots(spark, monkeypatch):
    monkeypatch.setattr(suffix, "LARGE_KEY", 1)
    check(spark, corpus(2))
    monkeypatch.setattr(suffix, "LARGE_KEY", 3)
    check(spark, corpus(3))
    monkeypatch.setattr(suffix, "_CHUNK", 300)
    doc, s, n, *_ = suffix.runs_of(np.frombuffer(b"abcdefgh" * 300, np.uint8), np.array([0, 1000, 1000, 2400]))
    assert n.sum() == 801 + 1201


def test_nulls_empty_and_extra_columns(spark):
    clash = "key int, did string, th string, _did int, _th int, _marks int, s int, content int, repeated_spans int"
    df = spark.createDataFrame([(None, None, *range(9)), (5, "z" * 300, *range(9))], f"doc_id long, text string, {clash.replace('did string', 'did int').replace('th string', 'th int')}")
    got = suffix.suffix_dedup(df)
    assert got.columns == df.columns and sorted(tuple(r)[2:10] for r in got.collect()) == [tuple(range(8))] * 2
    cut = suffix.without_spans(got)
    assert sorted(r.text or "" for r in cut.collect()) == ["", ""] and cut.columns == df.columns[:-1]
    assert [r.n_removed for r in suffix.span_digest(got).orderBy("doc_id").collect()] == [0, 300]
    assert suffix.suffix_dedup(df.limit(0)).count() == 0


def test_cut_keeps_whole_characters(spark):
    a, b = "é" + "x" * 220 + "tail one", "è" + "x" * 50 + "q" * 9
    df = spark.createDataFrame([(1, a), (2, b), (3, "ê" + "x" * 220 + "other")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffix.without_spans(suffix.suffix_dedup(df)).collect()}
    assert out[2] == b and out[1].startswith("é") and out[3].startswith("ê")
