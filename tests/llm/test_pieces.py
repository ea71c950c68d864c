"""The transducer against the library's own encoding."""

import random

import pytest
import sentencepiece

from ledgerlens.llm.piece_transducer import decode_pieces, encode_pieces
from ledgerlens.llm.q_pieces import machine, tokenizer_file


@pytest.fixture(scope="module")
def made():
    return machine()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_file("piece_bpe_32k.model")))


def odd_texts():
    rng = random.Random(4)
    signs = "aabcdeeinorst  \n\t.,éñ中文\U0001f600\u2581\u0301'019_-"
    fixed = ["", " ", "  ", "   ", "\n", " \n ", "a", " a", "a ", "a  b   c    d", "x" * 300, " " * 50 + "if x:\n\treturn  1", "\u2581a\u2581\u2581b"]
    return fixed + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]


def test_ids_are_the_library_s(made, library):
    texts = odd_texts()
    assert [ids.tolist() for ids in made.encode_many(texts)] == library.encode(texts)


def test_ids_do_not_depend_on_what_is_remembered(made, library):
    texts = odd_texts()[:300]
    assert [ids.tolist() for ids in made.encode_many(texts, 1)] == library.encode(texts)


def test_decoding_is_the_library_s(made, library):
    rng = random.Random(8)
    runs = [[rng.randrange(3, 32_000) for _ in range(20)] for _ in range(200)]
    runs += [[rng.randrange(3, 400) for _ in range(20)] for _ in range(200)]
    for ids in runs:
        assert made.decode(ids) == library.decode(ids)


def test_frames(spark, made, library):
    rows = [(1, "Hello  wörld\n", "x", 5), (2, None, None, None), (None, "", "y", 1), (1, "Hello  wörld\n", "x", 5), (3, "a b " * 300_000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    got = encode_pieces(docs, made, decoded=True)
    assert all(r["round_trip"] and r["decoded"] == (r["text"] or "") for r in got.collect())
    assert sorted(r["n_ids"] for r in got.collect()) == sorted(len(library.encode(t or "")) for _, t, _, _ in rows)
    again = decode_pieces(got.select("text", "ids"), made).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in again)
    assert encode_pieces(docs.limit(0), made).collect() == []


def test_query(spark, library):
    from ledgerlens.llm.q_pieces import op10_sentencepiece

    path = "/root/testdata/sf0.01"
    texts = dict(tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    for r in op10_sentencepiece(spark, path).collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]] or "") and r["round_trip"]
