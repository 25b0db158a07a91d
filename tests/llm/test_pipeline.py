import corpus_pipeline as C


def test_stages(spark, table, tmp_path):
    docs = table.selectExpr("doc_id", "text", "lang", "source", "length(text) n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        seen[name] = {r.doc_id for r in now.collect()}
    assert not {130, 131, 132} & seen["language_id"]
    assert not set(range(100, 105)) & seen["line_dedup"]  # copies lose all their lines
    assert seen["suffix_dedup"] <= seen["simhash_dedup"] <= seen["line_dedup"] <= seen["language_id"]
    pieces = C.STAGES[-1][1](spark, now, str(tmp_path))
    assert sorted(r.doc_id for r in pieces.select("doc_id").distinct().collect()) == sorted(seen["suffix_dedup"])
    assert C.run(spark, str(tmp_path)).count() == pieces.count()
