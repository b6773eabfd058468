import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import spots


def naive(text):
    words = ["".join(w).lower() for w in (text or "").replace("\x0b", " ").split(" ")]
    words = [w.strip(".,*") for w in words if w.strip(".,*")]
    out = set()
    for k, w in enumerate(words):
        if w in spots.ANCHORS:
            chain = [x for x in words[k + 1 :] if x not in spots.ANCHORS][: spots.CHAIN]
            if len(chain) == spots.CHAIN:
                out.add((w, *chain))
    return out or set(words) or ({text} if text else set())


def corpus():
    r = random.Random(8)
    words = ["the", "of", "und", "la", "Stone.", "river", "*moon*", "a", "sun,", "cloud", "tree", "bird", "été"]
    return [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 40, 300])))) for k in r.sample(range(1000), 60)] + [(2000, None), (2001, "..."), (2002, "xyz")]


def expected(rows):
    order = sorted(rows, key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(naive(t), naive(edited)), like(naive(t), naive(nxt)))
    return out


def test_like_naive(spark):
    rows = corpus()
    want = expected(rows)
    got = spots.edited_prints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(following)


def test_ids_repeat_and_nulls(spark):
    rows = [(5, "the red house of the king", 1), (5, "the red house of the king", 1), (None, "a b", 1), (7, "zz", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = spots.edited_prints(df).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert sorted(r.near_next for r in got if r.doc_id == 5)[1] == 1.0
    one = spots.edited_prints(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spots.edited_prints(df.limit(0)).count() == 0


def test_pruning():
    a = (np.array([1, 2, 3, 4, 9], np.uint32), np.array([4, 1]))
    b = (np.array([1, 9], np.uint32), np.array([1, 1]))
    assert spots.likeness(a, b).tolist() == [0.25, 1.0] and spots.likeness(a, b, 0.5).tolist() == [0.0, 1.0]


def test_length_parts():
    parts = spots.length_parts(80, 5000)
    part = lambda n: int(np.searchsorted(parts, n, side="right"))
    assert all(part(n * 100 // 80) - part(n) in (0, 1) for n in range(1, 4000))


def test_duplicates(spark):
    r = random.Random(2)
    words = ["the", "of", "and"] + [f"w{k}" for k in range(400)]
    out = []
    for _ in range(8):
        base = [r.choice(words[:3]) if r.random() < 0.4 else r.choice(words) for _ in range(r.choice([6, 60, 300]))]
        for _ in range(8):
            text = list(base)
            for _ in range(int(len(text) * r.choice([0, 0.01, 0.03]))):
                text[r.randrange(len(text))] = r.choice(words)
            out.append(" ".join(text))
    rows = list(enumerate([*out, "", None, "x", "x"]))
    sets = [(i, naive(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    got = spots.spot_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_items, x.component_id) for x in got} == {i: (len(s), root(i)) for i, s in sets}


def test_blocks(spark):
    r = random.Random(4)
    for count in (0, 1, 5, 64, 65, 1000):
        splits = sorted({(r.randint(-50, 50), r.randint(-(2**62), 2**62)) for _ in range(count)})
        keys = [(r.randint(-60, 60), r.randint(-(2**62), 2**62)) for _ in range(300)] + splits[:20]
        df = spark.createDataFrame(keys, "a long, b long")
        for fan in (3, 64):
            got = [x[0] for x in df.select(spots.block_of(F.struct("a", "b"), splits, "struct<a:bigint,b:bigint>", fan)).collect()]
            assert got == [sum(x <= k for x in splits) for k in keys]


def test_many_rows_of_one_id(spark):
    """They part by their texts, and follow each other all the same."""
    rows = [(7 if k % 3 else None, f"the house {k} of the king {k % 5} " * (k % 4)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = spots.edited_prints(df).collect()
    th = {x.text or "": x.th for x in df.select("text", F.xxhash64("text").alias("th")).collect()}
    order = sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), th[x[1]]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        want.append((str(i), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.edited_sha256) for x in got) == sorted(want)


def test_very_long_text(spark):
    rows = [(1, "the red house of the old king " * 20_000), (2, "a small boat"), (3, "the red house of the old king " * 20_000)]
    got = {x.doc_id: x for x in spots.edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].n_chars == 600_000 and got[1].near_next == 1.0 and got[1].fingerprint == got[3].fingerprint
    assert {x.doc_id: x.component_id for x in spots.spot_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 1}


def test_slices_of_batches(spark):
    """Texts of several megabytes in one partition, with characters of several bytes."""
    r = random.Random(3)
    words = ["the", "von", "für", "été", "más", "Straße", "中文"] + [f"wört{k}" for k in range(2000)]
    base = [" ".join(r.choice(words) for _ in range(150)) for _ in range(1500)]
    rows = [(k, base[k % 1500]) for k in range(3000)]
    got = spots.spot_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {x.doc_id: x.component_id for x in got} == {k: k % 1500 for k in range(3000)}
