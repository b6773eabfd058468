import random
import re

from emberlog.llm import families, minhash


def brute(rows, words, similar=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i) if s else i, (root(i) if s else i) == i) for i, s in sets)


def corpus(seed, families=6, copies=12):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "γάμμα", "delta"]) + str(r.randint(0, 300))
    out = []
    for _ in range(families):
        base = [word() for _ in range(r.choice([3, 12, 60, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(int(len(text) * r.choice([0, 0.03, 0.06, 0.1]))):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text))
    out += ["", None, "   \n\t", "one", "ONE", "one two", "one\x0btwo", "one\x1ctwo", "x y " * 900, "a b", "a b", out[3], out[3]]
    r.shuffle(out)
    return list(enumerate(out))


def check(spark, rows, words):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, words).collect())) == brute(rows, words)


def test_like_brute_force(spark):
    check(spark, corpus(1), 2)


def test_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(families, "ROWS", 5)
    monkeypatch.setattr(families, "DIRECT", 8)
    monkeypatch.setattr(families, "FEW", 2)
    check(spark, corpus(2, 3, 25), 5)


def test_blocks_and_rounds_by_levels(spark, monkeypatch):
    """As above, with no family small enough for one task."""
    monkeypatch.setattr(families, "ITEMS", 0)
    test_blocks_and_rounds(spark, monkeypatch)


def test_a_large_group_takes_few_jobs(spark, monkeypatch):
    """A group of near copies that meet in large buckets needs no level of its own: those cost up to 30 jobs each."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(families, "DIRECT", 8)
    monkeypatch.setattr(families, "family_links", None)
    check(spark, corpus(2, 3, 25), 5)


def test_empty_table_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (7, "a b c", 2), (7, "a b c", 2), (None, None, 3), (9, None, 4)], "doc_id long, text string, n long")
    got = sorted(map(str, map(tuple, minhash.near_duplicates(df).collect())))
    assert got == sorted(["(None, 1, 7, False)", "(7, 1, 7, True)", "(7, 1, 7, True)", "(None, 0, None, True)", "(9, 0, 9, True)"])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_other_texts_under_one_id(spark):
    """Null and repeated ids name no set: each text is linked by what it holds."""
    r = random.Random(4)
    base = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(80)) for _ in range(30)]
    near = [t + " end" for t in base]
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(near)] + [(3, near[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [3 if k == 0 else 100 + k if k % 2 else 7 for k in range(30)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert {c for i, c, _ in got if i == 100} == {3} and {c for i, c, _ in got if i == 7} == {3, 7}
    for k in range(1, 30):
        assert {(c, kept) for i, c, kept in got if i == 100 + k} == {(want[k], k % 2 == 1)}
    assert minhash.representatives(df).count() == 30


def test_many_posts_that_differ_in_one_word(spark):
    """None is linked with another, though all meet in a bucket: work and memory follow the rows, not their pairs."""
    made = "concat('the quick brown fox x', id, ' jumps over the lazy dog and then sleeps')"
    docs = spark.range(12_000).selectExpr("id as doc_id", f"{made} as text").unionByName(spark.createDataFrame([(20_000, "the quick brown fox x7 jumps over the lazy dog and then")], "doc_id long, text string"))
    got = minhash.near_duplicates(docs, words=2)
    assert got.where("not kept").collect() == [(20_000, 11, 7, False)] and got.count() == 12_001


def test_clashing_columns_and_a_very_long_text(spark):
    long = " ".join(f"w{k % 50_021}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c"), (4, None)]
    names = "id string, th int, n string, best int, node long, key string, comp int, a int, b int, hub int"
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z", 4, 5, 6, 7) for r in rows], f"doc_id long, text string, {names}")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    assert [x[0:1] + x[2:] for x in got] == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)] and got[1][1] == got[0][1] + 1
