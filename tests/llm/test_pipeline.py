import corpus_pipeline

from quillspark.llm.scratch import cut


def test_stages(spark, sf):
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, sf), "test-stage")
        assert out.columns == start.columns, name
        ids, had = {r.doc_id for r in out.collect()}, {r.doc_id for r in docs.collect()}
        assert ids <= had and len(ids) > 0.6 * len(had)
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} <= set(before)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_near_copies_from_eighty_percent_on_go(spark, sf, docs_of):
    base = [f"w{i}" for i in range(204)]
    # 20 of 200 shingles change on each side: 180 of 220 are shared
    copy = ["x" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)]
    small = [f"s{i}" for i in range(8)]  # four shingles; one more word makes five, four of them shared
    pairs = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(small)), (4, " ".join([*small, "end"]))]
    assert {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs_of(pairs), sf).collect()} == {1, 3}


def _tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 1, 0), (9, 0, 1), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the same line"), (2, None), (None, "x y z")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_odd_documents(spark, odd, tmp_path):
    rows = corpus_pipeline.run(spark, _tables(spark, tmp_path, odd)).collect()
    ids = {r.doc_id for r in rows}
    # the copy of 6, the near copy of 4 and the document that holds an item go
    assert 7 not in ids and 5 not in ids and 9 not in ids and {6, 8} <= ids <= {1, 2, 3, 4, 6, 8, None}
    assert {r.offset for r in rows if r.doc_id == 6} and sum(r.length for r in rows if r.doc_id == 6) > 4096


def test_run_on_no_documents_and_on_nulls_alone(spark, none, docs_of, tmp_path):
    out = corpus_pipeline.run(spark, _tables(spark, tmp_path / "none", none))
    assert out.collect() == [] and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    nulls = spark.createDataFrame([(None,) * len(none.columns)] * 3, none.schema)
    assert {(r.doc_id, r.length) for r in corpus_pipeline.run(spark, _tables(spark, tmp_path / "null", nulls)).collect()} <= {(None, 1)}
