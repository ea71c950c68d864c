"""Range-coded token blocks: exact round trips, damage, order and offsets."""

import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_blocks
from ledgerlens.llm.q_pieces import tokenizer_file
from ledgerlens.llm.range_coder import CorruptBlock, decode_block, encode_block

JSON = Path(tokenizer_file("word_bpe_49k.json"))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 511, 512, 5000, 300_001])
@pytest.mark.parametrize("kind", ["one", "few", "all", "runs"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n + 1)
    ids = {
        "one": np.full(n, 7),
        "few": rng.integers(0, 5, n),
        "all": rng.integers(0, 65_536, n),
        "runs": np.repeat(np.minimum(rng.zipf(1.3, n), 65_535), 3)[:n],
    }[kind]
    block = encode_block(ids, 65_536)
    assert np.array_equal(decode_block(block), ids)
    if n > 250_000:
        bits = {"one": 0.5, "few": 3.3, "all": 18, "runs": 9}[kind]
        assert len(block) * 8 / n < bits


def test_damage_is_found():
    block = bytearray(encode_block(np.arange(1000) % 50, 64))
    for at in (0, 5, 9, 20, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises((CorruptBlock, ValueError)):
            decode_block(bytes(bad))
    with pytest.raises(CorruptBlock):
        decode_block(bytes(block[:-2]))
    with pytest.raises(ValueError):
        encode_block(np.array([64]), 64)


def test_word_ids_are_the_library_s():
    library = Tokenizer.from_file(str(JSON))
    rng = random.Random(2)
    signs = "aAbeEiİnoΣςσ éÉñß\t\n\r\x0b\x0c\x1c\x85\xa0.,;:!?'’#*<|>12́中\U0001f600"
    texts = ["it's.", "ΑΣ ΑΣ.", "<|endoftext|> a", "a<|startoftext|>", "'S 'Ll don't!?", "x" * 5000, "é.", ""]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_blocks.ids_of(texts, JSON.read_text()) == want


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_files(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(token_blocks, "BLOCK_IDS", size)
    library = Tokenizer.from_file(str(JSON))
    rows = [(i, f"word{i} some more text, {'again ' * (i % 7)}") for i in range(200)]
    rows += [(None, "no id"), (-5, None), (500, ""), (7, "other text"), (7, "other text"), (900, "long " * 30_000)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    token_blocks.write_token_blocks(docs, str(tmp_path / "t"), JSON.read_text())
    got = token_blocks.read_token_blocks(spark, str(tmp_path / "t"), with_ids=True).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i is not None, i or 0, ids(t)) for i, t in rows)
    at, last = 0, (False, 0)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["doc_id"] is not None, r["doc_id"] or 0) >= last
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"])
        at, last = at + r["n_tokens"], (r["doc_id"] is not None, r["doc_id"] or 0)
    token_blocks.write_token_blocks(docs.limit(0), str(tmp_path / "e"), JSON.read_text())
    assert token_blocks.read_token_blocks(spark, str(tmp_path / "e")).collect() == []


def test_query(spark):
    from ledgerlens.llm.q_blocks import op7_token_blocks

    path = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(str(JSON))
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    encoded = library.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    want, at = [], 0
    for (i, _), e in zip(docs, encoded):
        ids = np.array([*e.ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op7_token_blocks(spark, path).collect()) == want


@pytest.mark.parametrize("gather", [7, 1 << 15])
def test_library_is_asked_once_for_a_word(monkeypatch, gather):
    """Batches with nulls, added tokens and slices: the library's ids, asked for distinct words only."""
    monkeypatch.setattr(token_blocks, "GATHER", gather)
    library = Tokenizer.from_file(str(JSON))
    made, asked = token_blocks.WordTokenizer(JSON.read_text()), []
    monkeypatch.setattr(made, "_library", lambda texts, own=made._library: asked.extend(texts) or own(texts))
    rng = random.Random(6)
    words = ["plain", "Plain", "straße,", "ÉTÉ", "x-1", "x-1.", "it's", "end***", "ΑΣ", "中文", "***", "12", "12,", "İi", "ét"]
    texts = [None, "", " \n ", "a <|endoftext|> b", None, "c<|startoftext|>"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", " ", "\t"]) for _ in range(300)]
    rng.shuffle(texts)
    for part in (pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts[:0], pa.string())):
        want = [e.ids for e in library.encode_batch([t or "" for t in part.to_pylist()], add_special_tokens=False)]
        ids, lengths = made.encode(part)
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    once = [t for t in asked if "<|" not in t]
    assert len(once) == len(set(once)) <= len(words) + 2


def test_order_zero_learns_in_early_steps():
    """A block of one id, short lanes: its ids cost little from the second step on."""
    assert len(encode_block(np.full(4096, 7), 65_536)) < 400


def test_a_kept_word_takes_few_bytes(monkeypatch):
    """A worker keeps hundreds of thousands of words beside others and the executor's heap."""
    made = token_blocks.WordTokenizer(JSON.read_text())
    monkeypatch.setattr(made, "_library", lambda texts: [b"\1\0\0\0"] * len(texts))
    letters, n = "abcdefghij", 100_000
    text = " ".join("".join(letters[int(c)] for c in str(k)) for k in range(n, 2 * n))
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    made.encode(pa.array([text]))
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert kept < 60 * n


@pytest.mark.parametrize("limit", ["MEMO", "MEMO_BYTES"])
def test_a_full_memo_is_cut_down(monkeypatch, limit):
    monkeypatch.setattr(token_blocks, limit, 40)
    library = Tokenizer.from_file(str(JSON))
    made, rng = token_blocks.WordTokenizer(JSON.read_text()), random.Random(8)
    for _ in range(60):
        words = [f"{rng.choice('abé')}{chr(97 + rng.randrange(26))}{rng.choice(['', 'x-1', '.', '!?', '中'])}" for _ in range(rng.randrange(90))]
        texts = [" ".join(words), None, " ".join(words[::2])]
        ids, lengths = made.encode(pa.array(texts, rng.choice([pa.string(), pa.large_string()])))
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        for memo in (made.cores, made.others):
            assert len(memo.words) == len(memo.size) and memo.size.sum() == len(memo.flat)
            assert len(memo.words) <= token_blocks.MEMO and memo.words.nbytes <= token_blocks.MEMO_BYTES


def test_pieces_have_bounded_texts(monkeypatch):
    """Batches of any size are tokenised in pieces, every document once and in order."""
    monkeypatch.setattr(token_blocks, "PIECE", 400)
    rng = random.Random(9)
    rows = [(k, rng.choice([None, "", "a" * rng.randrange(90)])) for k in range(500)]
    rows[100] = (100, "long" * 500)
    cuts = [0, 0, 3, 3, 200, 450, 500]
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in rows[a:b]], "text": pa.array([t for _, t in rows[a:b]], pa.string())}) for a, b in zip(cuts, cuts[1:])]
    pieces = [list(zip(i.to_pylist(), t.to_pylist())) for i, t in token_blocks._pieces(iter(batches))]
    assert [r for piece in pieces for r in piece] == rows
    sizes = [sum(len(t or "") for _, t in piece) for piece in pieces]
    assert sorted(sizes)[-2] <= 400 and min(sizes[:-1]) >= 300 and max(sizes) < 2400
