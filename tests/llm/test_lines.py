import duckdb

from emberlog.llm import common, lines
from emberlog.llm.queries import op8_line_dedup


def test_like_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({lines.SQL})").fetchall())
    got = op8_line_dedup(spark, sf)
    assert sorted(map(tuple, got.collect())) == want and sum(r[2] for r in want) > 100


def test_cases(spark):
    rows = [(k, f"shared\n own {k} \n\n shared ", f"s{k % 7}", 1) for k in range(20)]
    rows += [(30, None, "s1", 1), (31, "", "s2", 1), (32, "shared", None, 1), (None, "shared\nx", "s3", 1), (5, rows[5][1], "s5", 1)]
    rows += [(40 + k, "rare", f"s{k % 5}", 1) for k in range(10)] + [(60 + k, "null site", None, 1) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {}
    for r in lines.spread_lines(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[0][0].text == "shared\n own 0 \n" and got[0][0].n_removed == 1
    assert got[1][0].text == " own 1 \n" and got[1][0].n_lines == 4
    assert [r.text for r in got[5]] == [" own 5 \n"] * 2
    assert got[30][0].text is None and got[31][0].text == "" and got[32][0].text == "" and got[None][0].text == "x"
    assert all(got[40 + k][0].text == "rare" for k in range(10)) and got[60][0].text == got[69][0].text == "null site"
    assert lines.spread_lines(df.limit(0)).count() == 0


def test_clashing_columns_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)  # lines that a quarter of the rows hold are met by broadcast
    rows = [(k, f"shared\n own {k}", f"s{k % 7}", k, -k, 1, 2, 3, "p") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _did long, _th long, _gone int, did int, gone int, pos string")
    got = lines.spread_lines(df).orderBy("doc_id").collect()
    assert [tuple(r)[:9] for r in got] == [(k, t if not k else f" own {k}", *rest) for k, t, *rest in rows]
    assert [r.n_removed for r in got] == [0] + [1] * 19


def test_very_long_text(spark):
    text = "\n".join(f"line {k}" for k in range(200_000))
    rows = [(k, text if k == 3 else f"line {k}\nline 199999", f"s{k}") for k in range(9)]
    got = {r.doc_id: r for r in lines.spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].n_lines == 200_000 and got[3].n_removed == 1 and got[0].n_removed == 0 and got[8].n_removed == 1
