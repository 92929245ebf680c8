from tessella.plans.catalogue import QUERIES


def test_runs_of_more_than_four_terms_are_covered(spark, tmp_path):
    parts = "abc def ghi jkl mno pqr".split()
    rows = [(1, f"{''.join(parts)} {' '.join(parts)} zebra")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["covered_subwords"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.n, r.positions) for r in got] == [(1, 2, 7)]


def test_nothing_is_shuffled_before_counting(spark, capsys):
    from tessella.operators import keywords

    docs = spark.createDataFrame([(1, "abcdef abc def zebra"), (2, None), (3, "of the")], "doc_id long, text string")
    left = keywords.uncovered(docs)
    assert [tuple(r) for r in left.collect()] == [(1, 0, "abcdef"), (1, 3, "zebra")]
    left.explain()
    assert "Exchange" not in capsys.readouterr().out
