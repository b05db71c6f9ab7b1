from sparkscape.plans import extra


def test_last_version_is_the_whole_corpus(spark, tmp_path):
    rows = [(i, "alpha beta gamma" if i % 2 else "alpha beta delta") for i in range(1, 2001)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = extra.QUERIES["w_prefixes_whole"](spark, str(tmp_path)).collect()
    assert [r.size for r in got] == [667, 1333, 2000]
    assert got[-1].total == 2000 + 2 * 2000  # alpha-beta in all, and two more pairs in each
