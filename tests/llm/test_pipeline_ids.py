"""Decisions of the decontamination stage reach rows with null and repeated ids."""

import corpus_pipeline

PATH = "/root/testdata/sf0.001"


def test_leaks_go_without_an_id_and_by_row(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    passage = spark.read.parquet(f"{PATH}/benchmark.parquet").first()["text"]
    texts = [(None, passage), (None, "nothing of the kind"), (5, passage + " and more"), (5, "another text"), (6, None), (None, None)]
    empty = {c: None for c in docs.columns}
    rows = [tuple({**empty, "doc_id": i, "text": t}.values()) for i, t in texts]
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, docs.schema), PATH)
    got = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert got == {(None, "nothing of the kind"), (5, "another text"), (6, None), (None, None)}
