"""Stages with extra columns of any name, rows that share an id, and workers without this package."""

import pickle
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

PATH = "/root/testdata/sf0.001"
#: Names that stages or their operators use for themselves.
NAMES = [
    "score", "_score", "sign", "gone_id", "gone_sign", "_gone_id", "n_lines", "n_dropped", "rest", "_own", "_id", "_sign", "_text", "_lost",
    "_lost_id", "_lost_sign", "_copy", "_leak", "_toxicity", "id", "node", "kept", "component_id", "n_shingles", "words", "item", "seeds", "at",
]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_columns_of_any_name_pass_through(spark, stage):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    plain = {r["doc_id"]: r["text"] for r in stage[1](spark, docs, PATH).collect()}
    marked = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in NAMES})
    out = stage[1](spark, marked, PATH)
    assert out.columns[: len(marked.columns)] == marked.columns
    rows = out.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain and len(rows) == len(plain)
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)


def test_unique_text_stays_beside_a_copy(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    copy, unique = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    empty = {c: None for c in docs.columns}
    rows = [tuple({**empty, "doc_id": i, "text": t}.values()) for i, t in ((1, copy), (2, copy), (2, unique), (None, copy), (3, None), (None, None))]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, docs.schema), PATH)
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(1, copy), (2, unique), (None, copy), (3, None), (None, None)], key=str)


def test_machine_travels_without_the_package(tmp_path):
    """What encode_pieces broadcasts can be read where the package is not installed."""
    from ledgerlens.llm.q_pieces import machine

    path = tmp_path / "parts"
    path.write_bytes(pickle.dumps(vars(machine())))
    code = f"import pickle; parts = pickle.load(open({str(path)!r}, 'rb')); assert 'pieces' in parts"
    subprocess.run([sys.executable, "-I", "-c", code], check=True, cwd=tmp_path)


def test_large_components_are_refused(spark):
    from ledgerlens.llm.topk_search import top_k

    rows = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(rows, F.col("vec_id") == 0)
