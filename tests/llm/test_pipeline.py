import random
import re

import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_brute
from test_suffix import brute as suffix_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "river", "stone", "cloud", "moon", "tree"]) + r.choice(["", "s", "ed", "ing"]) + str(r.randint(0, 99))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, boiler = prose(60), "All rights reserved."
    texts = [prose(r.randint(5, 120)) + "\n" + boiler for _ in range(30)]
    base = prose(200)
    texts += [base, base, base.replace("stone", "rock", 1), prose(30) + "\n" + passage, passage + "\n" + prose(20), boiler, None, "", "123 456", "..."]
    return [(k, t, "en", f"s{k % 9}", len(t or "")) for k, t in enumerate(texts)]


def line_brute(rows):
    places = {}
    for i, t, _, s, _ in rows:
        for k, line in enumerate(t.split("\n")):
            if line.strip(" "):
                places.setdefault(line.strip(" "), []).append((i, k, s))
    gone = {(i, k) for p in places.values() if len({s for *_, s in p}) >= 6 for i, k, _ in p if (i, k) != min(x[:2] for x in p)}
    out = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), lang, s) for i, t, lang, s, _ in rows]
    return [(i, t, lang, s, len(t)) for i, t, lang, s in out if t.strip(" ")]


def test_stages_like_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [x for x in rows if x[1] and re.search(r"[^\W\d_]", x[1])]
    for (name, stage), brute in zip(
        corpus_pipeline.STAGES,
        (
            lambda x: x,
            line_brute,
            lambda x: [d for d in x if d[0] in {i for i, _, _, kept in near_brute([(d[0], d[1]) for d in x], 5) if kept}],
            None,
            None,
        ),
        strict=True,
    ):
        out = stage(spark, docs, "")
        if name == "suffix-array dedup":
            removed = {i: n for i, _, n, _, _ in suffix_brute([(d[0], d[1]) for d in want])}
            got = {r.doc_id: r.text for r in out.collect()}
            for i, t, *_ in want:
                assert len(got.get(i, "").encode()) == len(t.encode()) - removed[i]
            want = [(i, got[i], lang, s, len(got[i])) for i, t, lang, s, _ in want if i in got]
        elif name == "packing":
            assert {r.doc_id for r in out.collect()} == {d[0] for d in want}
            continue
        else:
            want = brute(want)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, out.collect())) == sorted(want), name
        docs = spark.createDataFrame(want, SCHEMA)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_near_dedup_keeps_texts_of_null_and_repeated_ids(spark):
    r = random.Random(6)
    base = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(80)) for _ in range(12)]
    ids = [None, None, None, None, 5, 5, 5, 5, 1, 2, 3, 4]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, base, strict=True)]
    copies = [(None, base[0] + " end", "en", "s", 0), rows[1], rows[4], (5, base[5] + " end", "en", "s", 0), (9, base[2] + " end", "en", "s", 0), (None, base[8], "en", "s", 0)]
    docs = spark.createDataFrame(rows + copies, SCHEMA)
    got = [(d.doc_id, d.text.removesuffix(" end")) for d in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    want = [(9 if k == 2 else i, t) for k, (i, t) in enumerate(zip(ids, base, strict=True))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_language_stage_without_labels(spark):
    texts = ["a river", "", None, "123 456", "γη"]
    docs = spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    assert sorted(d.doc_id for d in corpus_pipeline.identify_language(spark, docs, "").collect()) == [0, 4]


def test_language_stage_fills_what_it_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null").select("doc_id", "text", "lang", "source", "n_chars")
    some = docs.where("doc_id % 50 = 7")
    unnamed = docs.join(some.select("doc_id"), "doc_id", "left_anti").unionByName(some.withColumn("lang", F.lit(None).cast("string")))
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, unnamed, "").collect()}
    want = {r.doc_id: r.lang for r in some.collect()}
    assert sum(got[i] == lang for i, lang in want.items()) > 0.9 * len(want) and all(got.values())
