import corpus_pipeline
import __spark_entry__ as E

SF001 = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = E.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names


def test_stages_keep_columns_and_clean_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (odd_docs, no_docs):
            assert stage(spark, given, SF001).columns == given.columns
            stage(spark, given, SF001).count()
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        kept = out.count()
        assert 0 < kept <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_the_run_equals_its_stages_by_hand(spark):
    from quarry.llm import langid, minhash, quality
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    a = docs.toPandas()
    lang = langid.classify(a["text"], model)
    a = a[((lang["lang_pred"] != "und") & (lang["score"] >= langid.MIN_SCORE)).to_numpy()]
    a = a[quality.judge(a["text"], quality.fit(spark.createDataFrame(a), labels))["kept"].to_numpy()]
    near = {r["doc_id"] for r in minhash.near_duplicates(spark.createDataFrame(a)).collect() if r["kept"]}
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {r["doc_id"] for r in got} == near
