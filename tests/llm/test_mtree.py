import numpy as np
import pytest

from emberlog.llm import mtree


def brute(rows, k=20, every=20):
    """With integers of any size, so floor(64 * x) is exact for every finite x."""
    whole = lambda v: [int(np.floor(64 * x)) if abs(x) < 2**60 else 64 * int(x) for x in v]
    good = [(i, whole(v)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in good if i % every == 0}.items():
        score = lambda x, q=q: sum(a * b for a, b in zip(q, x, strict=True))
        got = sorted((-score(x), j) for j, x in good if j != i and len(x) == len(q))[:k]
        out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"TREE": 100, "SMALL_TREE": 50, "PAGE": 16, "FAN": 3, "BATCH": 7, "BLOCK": 20}, {"SMALL_TREE": 300, "PAGE": 8, "FAN": 2, "SAMPLE": 5}])
def test_like_brute_force(spark, monkeypatch, limits):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.1).round(2).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[20][1]) for i in range(300)]  # one very common vector: ties by id
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2020, [float("nan")] * 8), (2040, [float("inf")] * 8), (2060, [1.0, 2.0]), (2061, [0.5, 0.5]), (2080, [0.0] * 8), (None, [1.0] * 8)]
    rows += [(20, []), (40, []), (3, [])]
    df = spark.createDataFrame([(*x, 1.5, "t") for x in rows], "vec_id long, embedding array<double>, x double, tree string")
    for name, value in limits.items():
        monkeypatch.setattr(mtree, name, value)
    assert sorted(map(tuple, mtree.top_products(df).collect())) == brute(rows)
    assert mtree.top_products(df.where("vec_id is null")).count() == 0


def test_large_components(spark, monkeypatch):
    """Finite vectors of any size take part, and scores beyond 2^53 are exact."""
    monkeypatch.setattr(mtree, "SMALL_TREE", 8)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-(2**22), 2**22, 6)]) for i in range(60)]
    rows += [(100 + i, [float(2**20 + i % 3), 1.0 / 64, float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)]
    assert sorted(map(tuple, mtree.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == brute(rows)
    rows += [(200, [2.0**41] + [0.0] * 5), (201, [2.0**41 + 1] + [0.0] * 5), (220, [1e300, -1e300, 0.0, 0.0, 0.0, 1.0]), (221, [1.7e308] * 6)]
    got = {x[:3]: x[3] for x in map(tuple, mtree.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect())}
    want = {x[:3]: x[3] for x in brute(rows, 4)}
    assert got.keys() == want.keys() and got == want


def test_repeated_rows_count_each(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (40, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, mtree.top_products(df, k=3).collect()))
    assert got == [(20, 1, 7, 12288), (20, 2, 7, 12288), (20, 3, 40, 0), (40, 1, 7, 4096), (40, 2, 7, 4096), (40, 3, 20, 0)]


def test_only_entries_that_pass_are_computed():
    """`computed` counts the entries of all matrices of distances and products that are made."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 6)) * 100
    points = np.floor(centres[r.integers(0, 40, 8000)] + r.normal(size=(8000, 6)))
    tree = mtree.MTree(points, np.arange(8000))
    assert len(tree.levels) == 3
    queries = points[:50]
    x, name, score, computed = tree.search(queries, np.arange(50), 5)
    product = queries @ points.T
    product[np.arange(50), np.arange(50)] = -np.inf
    for q in range(50):
        assert [s for s, k in zip(score, x, strict=True) if k == q] == sorted(product[q])[::-1][:5]
    assert computed < 0.35 * product.size
    # a floor lets nothing worse be looked for
    floor = np.array([min(s for s, k in zip(score, x, strict=True) if k == q) for q in range(50)], float)
    x2, name2, score2, less = tree.search(queries, np.arange(50), 5, floor)
    assert sorted(zip(x2, name2, score2, strict=True)) == sorted(zip(x, name, score, strict=True)) and less < computed
