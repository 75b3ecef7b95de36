"""The pipeline's stages on a small table, each against what it must do."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert sorted(after.columns) == sorted(docs.columns)
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        assert 0 < after.count() <= before.count()
        if name != "substring_dedup":
            assert after.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).isEmpty()


def test_odd_rows_stay_whole(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 800").limit(3)
    odd = clean.unionByName(spark.createDataFrame([(None, "x", None, None, None), (7001, None, None, None, None), (7002, "", None, None, 0)], clean.schema))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        ids = sorted(r.doc_id for r in stage(spark, odd, SF).where("doc_id is not null").collect())
        assert {7001, 7002} <= set(ids), name


def test_near_copies_keep_one_row(spark):
    words = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(40))
    rows = [(5, words), (5, words), (6, words), (3, other), (5, other), (7, ""), (7, ""), (8, None), (None, words), (None, words), (9, words + " tail")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert sorted(kept.columns) == sorted(corpus_pipeline.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(5, words), (3, other), (7, ""), (8, None), (None, words), (None, words)], key=str)
