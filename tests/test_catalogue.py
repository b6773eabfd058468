from emberlog import catalogue

TEXT = "And 5 % of the Xa at the"
DOCS = [(k, TEXT, lang, "s1") for k, lang in ((1, "en"), (8_415_360, "en"), (12_000_000, "de"), (None, "en"), (None, "de"))]
TURNS = [(conv, 1, "user", "hallo") for conv in (1, 1_136_074, 40_000_000)]


def test_registered_queries_cover_all_times(spark, tmp_path):
    """Large ids stand for times far ahead, a null id for none; no row is left out."""
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, want in (("line_literal_meta", [d[0] for d in DOCS]), ("line_re_dotall", [1, 8_415_360, None]), ("line_re_class", [12_000_000, None])):
        got = [r.seq for r in catalogue.ENTRIES[name].run(spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
    points = catalogue.ENTRIES["bytes_5m"].run(spark, str(tmp_path)).collect()
    assert len(points) == 4 and sum(r.value for r in points) == 5 * len(TEXT)
    assert [r.value for r in points if r.bucket is None] == [2 * len(TEXT)]
    turns = catalogue.ENTRIES["agg_conv_by_role"].run(spark, str(tmp_path)).collect()
    assert [r.value for r in turns] == [1.0] * 3 and len({r.bucket for r in turns}) == 3


def test_the_zone_of_the_session_changes_nothing(spark):
    sf = "/root/testdata/sf0.001"
    names = ("stored_records", "stored_rollup_1h", "truncated_flag", "container_records", "container_lines")
    run = lambda: {n: sorted(map(str, catalogue.ENTRIES[n].run(spark, sf).collect())) for n in names}
    want = run()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run() == want and all(want.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
