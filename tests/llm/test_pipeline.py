"""The pipeline's stages against brute force over a small table."""

import pytest
import sentencepiece

import corpus_pipeline
from ledgerlens.llm.q_pieces import tokenizer_file
from pyspark.sql import functions as F

from .test_decontamination import plain as plain_leaks
from .test_near import plain_components

PATH = "/root/testdata/sf0.001"


def plain_lines(docs):
    """{doc_id: text} after line dedup."""
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    held = {}
    for i, text in docs:
        for line in text.split("\n"):
            held.setdefault(key(line), set()).add(i)
    bad = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if bad.get(key(x), i) == i)) for i, t in docs]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{PATH}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, PATH).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def pairs(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns == stages[0][0].columns


def test_toxicity_takes_the_scored_ones(spark, stages):
    from ledgerlens.llm.toxicity import fit_toxicity, score_toxicity

    before, after = stages[0]
    model = fit_toxicity(before, spark.read.parquet(f"{PATH}/labels.parquet"))
    assert pairs(after) == pairs(score_toxicity(before, model).where("score < 0.5"))


def test_lines(stages):
    before, after = stages[1]
    assert pairs(after) == sorted(plain_lines(pairs(before)))


def test_near_dedup(stages):
    before, after = stages[2]
    rows = pairs(before)
    assert [i for i, _ in pairs(after)] == sorted(i for i, _, c in plain_components(rows, 85) if i == c)


def test_decontamination(spark, stages):
    before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").select("item_id", "text").collect()]
    whole = [(i, t) for i, t in pairs(before) if any(p in t for _, p in items)]
    gone = {i for i, _ in pairs(before)} - {i for i, _ in pairs(after)}
    assert gone == {i for i, _ in whole}
    some = [(i, t[:600]) for i, t in whole[:2]]
    assert all(any(p in t for _, p in items) <= bool(plain_leaks([(i, t)], items)) for i, t in some)


def test_pieces(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_file("piece_bpe_32k.model")))
    before, after = stages[4]
    rows = after.select("doc_id", "text", "ids", "round_trip").collect()
    assert len(rows) == before.count() > 0
    assert all(list(r["ids"]) == library.encode(r["text"] or "") and r["round_trip"] for r in rows)


def test_odd_documents(spark):
    """Nulls, empty and repeated rows, and an extra column pass through all stages."""
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, "one two", None, None, 7)], docs.schema
    ).withColumn("score", F.lit("kept"))
    for table in (odd, odd.limit(0)):
        got = table
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, PATH)
        assert sorted(map(str, got.select("doc_id", "score").collect())) == sorted(map(str, table.select("doc_id", "score").collect()))
