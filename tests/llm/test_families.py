import random

import pytest

from emberlog.llm import common, families


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def family(seed):
    """Sets from a few templates: with words of their own, with words from a small stock, with gaps, and chance components."""
    r = random.Random(seed)
    sets = []
    for t in range(4):
        size = r.choice([5, 11, 30, 60])
        template = [1000 * t + k for k in range(size)]
        for _ in range(r.choice([20, 60])):
            one = set(template)
            for _ in range(r.choice([0, 1, 1, size // 8])):
                one.discard(r.choice(template))
                one.add(r.choice([r.randint(10**6, 10**9), 500_000 + r.randint(0, 3)]))
            sets.append(tuple(sorted(one)))
    sets = sorted(set(sets))
    r.shuffle(sets)
    comps = list(range(len(sets)))
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
    known = roots(len(sets), [x for x in alike if r.random() < 0.02])
    return sets, [known[c] for c in comps], alike


def similar(a, b):
    common = len(set(a) & set(b))
    return 100 * common >= 80 * (len(a) + len(b) - common)


@pytest.mark.parametrize(("seed", "limits"), [(1, (512, 32, 128, 8)), (2, (512, 32, 7, 8)), (3, (4, 2, 5, 8)), (4, (4, 1, 3, 2)), (5, (3, 0, 4, 8))])
def test_like_brute_force(spark, monkeypatch, seed, limits):
    for name, value in zip(("DIRECT", "FEW", "ROWS", "LEVELS"), limits, strict=True):
        monkeypatch.setattr(families, name, value)
    sets, comps, alike = family(seed)
    rows = [(7, k, c, len(s), list(s)) for k, (s, c) in enumerate(zip(sets, comps, strict=True))]
    rows += [(8, 10_000 + k, 10_000 + c, len(s), list(s)) for k, (s, c) in enumerate(zip(sets, comps, strict=True))][: 3 + seed]
    got = [tuple(x) for x in families.family_links(spark.createDataFrame(rows, "key long, node long, comp long, n int, set array<long>"), 80).collect()]
    mine = [x for x in got if max(x) < 10_000]
    for a, b in mine:
        assert similar(sets[a], sets[b])
    known = list(enumerate(comps))
    assert roots(len(sets), known + mine) == roots(len(sets), known + alike)


@pytest.mark.parametrize(("seed", "cells"), [(1, 1 << 22), (2, 700), (6, 50)])
def test_few_rows_together(spark, monkeypatch, seed, cells):
    """One task finds what the levels find, without their jobs."""
    monkeypatch.setattr(families, "CELLS", cells)
    monkeypatch.setattr(families, "family_links", None)
    sets, comps, alike = family(seed)
    rows = [(7, k, c, len(s), list(s)) for k, (s, c) in enumerate(zip(sets, comps, strict=True))]
    rows += [(8, 10_000 + k, 10_000 + c, n, s) for _, k, c, n, s in rows]
    got = [tuple(x) for x in families.links_of(spark.createDataFrame(rows, "key long, node long, comp long, n int, set array<long>"), 80).collect()]
    for low in (0, 10_000):
        mine = [(a - low, b - low) for a, b in got if low <= a < low + 10_000 and low <= b < low + 10_000]
        assert all(similar(sets[a], sets[b]) for a, b in mine) and len(mine) * 2 == len(got)
        known = list(enumerate(comps))
        assert roots(len(sets), known + mine) == roots(len(sets), known + alike)


@pytest.mark.parametrize("limit", ["ITEMS", "PRODUCTS"])
def test_more_rows_by_levels(spark, monkeypatch, limit):
    """Beyond either limit nothing is left to one task."""
    monkeypatch.setattr(families, limit, 1000)
    monkeypatch.setattr(families, "_together", None)
    monkeypatch.setattr(families, "DIRECT", 4)
    sets, comps, alike = family(3)
    rows = [(7, k, c, len(s), list(s)) for k, (s, c) in enumerate(zip(sets, comps, strict=True))]
    got = [tuple(x) for x in families.links_of(spark.createDataFrame(rows, "key long, node long, comp long, n int, set array<long>"), 80).collect()]
    known = list(enumerate(comps))
    assert roots(len(sets), known + got) == roots(len(sets), known + alike)


def test_no_family_at_all(spark):
    assert families.links_of(spark.createDataFrame([], "key long, node long, comp long, n int, set array<long>"), 80).count() == 0


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
def test_components(spark, monkeypatch, few):
    """By rounds, by rounds and one task for the rest, and by one task."""
    monkeypatch.setattr(common, "UNITED", few)
    r = random.Random(few)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(560, [x for x in links if x[0] != x[1]])
    assert got == {k: want[k] for k in {k for x in links if x[0] != x[1] for k in x}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
