"""Token ids of a corpus in files of independent compressed blocks.

Documents are range-partitioned and sorted by id; every task tokenises its documents in that order, gathers
the ids of whole documents up to about ``BLOCK_IDS`` and writes each such block with the range coder as one
row: (part, seq, first, n_ids, doc_ids, lengths, block). ``part`` is the number of the task's range, ``seq``
the block's number within it, and ``first`` the ids before it within it, so that the files read in order of
(part, seq) hold all ids in ascending order of document. Blocks are decoded independently of one another.

Reading needs one number per part, the ids in all parts before it, to place every document.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import compress
from string import ascii_lowercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import byte_chunks, worker_state
from ledgerlens.llm.range_coder import decode_block, encode_block

BLOCK_IDS = 1 << 21
PIECE = 8 << 20  # bytes of texts tokenised at a time, at most, but for longer documents
MEMO, MEMO_BYTES = 450_000, 24 << 20
ENDS = ".,;:!?#%&*$"
SIMPLE = 0x250  # letters below: Latin, each with one composed form
GATHER = 1 << 15  # words whose ids are put together at a time


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The parts ``which`` of ``flat`` one after another; ``size`` has the size of each part."""
    start, parts = np.cumsum(size) - size, [flat[:0]]
    for k in range(0, len(which), GATHER):
        some = which[k : k + GATHER]
        n = size[some]
        stop = np.cumsum(n)
        at = np.repeat(start[some] - stop + n, n)
        at += np.arange(len(at))
        parts.append(flat.take(at))
    return np.concatenate(parts)


class _Memo:
    """Ids of words, kept in Arrow and numpy arrays: some 30 bytes a word, where a dict takes about 200."""

    def __init__(self):
        self.words, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 for words that are not kept."""
        return pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy().astype(np.int64)

    def add(self, words: pa.Array, ids: list[bytes]) -> np.ndarray:
        """Places of new words, which are distinct."""
        first = len(self.words)
        self.words = pa.concat_arrays([self.words.cast(words.type), words])
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        return np.arange(first, len(self.words))

    def trim(self, used: np.ndarray) -> None:
        """Beyond the limits, keep the words at the distinct places ``used`` alone, or none if they are too many."""
        for some in (used, used[:0]):
            if len(self.words) <= MEMO and self.words.nbytes + self.size.nbytes + self.flat.nbytes <= MEMO_BYTES:
                return
            self.flat = _gathered(self.flat, self.size, some)
            self.words, self.size = self.words.take(pa.array(some)), self.size[some]


class WordTokenizer:
    """Ids of a tokenizer file that drops white space, found word by word and kept per Python worker.

    Such a tokenizer cuts at white space and between letters and ASCII punctuation, so a text's ids are those
    of its words, and a word of letters with ``ENDS`` after it has those of the letters and of the rest. The
    library is asked once for each distinct word of a batch. It normalises letter by letter up to ``SIMPLE``, so
    words of these go to its model, each letter as its normaliser and pre-tokenizer have it.
    """

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for every core
        self.tokenizer = Tokenizer.from_str(json_text)
        self.limit = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cores, self.others = _Memo(), _Memo()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = [t for t in added if t]
        self.letters: dict[int, str] = {}
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for letter in filter(str.isalpha, map(chr, range(SIMPLE))):
            plain = normal.normalize_str(letter) if normal else letter
            pieces = cut.pre_tokenize_str(plain) if cut else [(plain, None)]
            if len(plain) == len(pieces) == 1 and plain.isalpha():
                self.letters[ord(letter)] = pieces[0][0]
        self.simple = re.compile("[" + "".join(map(chr, self.letters)) + "]+").fullmatch

    @staticmethod
    def of(json_text: str) -> WordTokenizer:
        state = worker_state("word_tokenizer")
        if state.get("json") != json_text:
            state.update(json=json_text, made=WordTokenizer(json_text))
        return state["made"]

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 4 bytes an id."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of letters alone."""
        simple, letters, model = self.simple, self.letters, self.tokenizer.model.tokenize
        # Words of ASCII letters come in lower case.
        same = all(letters.get(ord(c)) == c for c in ascii_lowercase)
        out, others = [], []
        for word in words:
            if simple(word):
                seen = word if same and word.isascii() else word.translate(letters)
                out.append(array("I", [t.id for t in model(seen)]).tobytes())
            else:
                others.append(len(out))
                out.append(b"")
        for k, ids in zip(others, self._library([words[k] for k in others])):
            out[k] = ids
        return out

    def _whole(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in ``others``."""
        place = self.others.find(words)
        missing = place < 0
        if missing.any():
            new = words.filter(pa.array(missing))
            place[missing] = self.others.add(new, self._library(_strings(new)))
        return place

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each of the distinct ``words``, all their ids)."""
        core = pc.utf8_rtrim(words, characters=ENDS)
        longer = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
        coded = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core).dictionary_encode()
        place = self.cores.find(coded.dictionary)
        missing = place < 0
        new = coded.dictionary.filter(pa.array(missing))
        names = _strings(new)
        # A letter may become a letter and a mark when it is lowered.
        plain = [c.isalpha() and (c.isascii() or c.lower().isalpha()) for c in names]
        mask = np.array(plain, bool)
        missing[missing] = mask
        if mask.any():
            place[missing] = self.cores.add(new.filter(pa.array(mask)), self._model(list(compress(names, plain))))
        first = place[coded.indices.to_numpy()]
        odd = first < 0
        whole = self._whole(words.filter(pa.array(odd)))
        ended = ~odd & (longer > 0)
        ends = [w[-n:] for w, n in zip(_strings(words.filter(pa.array(ended))), longer[ended].tolist())]
        distinct = list(dict.fromkeys(ends))
        last = self._whole(pa.array(distinct, words.type))
        of_end = dict(zip(distinct, last.tolist()))
        # The two memos one after the other, and an entry without ids.
        size, after = np.concatenate([self.cores.size, self.others.size, [0]]), len(self.cores.size)
        first[odd] = after + whole
        second = np.full(len(words), len(size) - 1)
        second[ended] = after + np.array([of_end[end] for end in ends], np.int64)
        both = np.stack([first, second], axis=1)
        ids = _gathered(np.concatenate([self.cores.flat, self.others.flat]), size, both.ravel())
        self.cores.trim(place[place >= 0])
        self.others.trim(np.unique(np.concatenate([whole, last])))
        return size[both].sum(axis=1), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null texts have none."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for token in self.apart:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        coded = lists.flatten().dictionary_encode()
        size, flat = self._words(coded.dictionary)
        which = coded.indices.to_numpy()
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = _gathered(flat, size, which)
        stops = np.concatenate([[0], np.cumsum(size[which])])[edges]
        lengths = np.diff(stops)
        if whole.any():
            # Texts that hold an added token: by the library alone.
            at = np.flatnonzero(whole).tolist()
            more = self._library([texts[k].as_py() for k in at])
            lengths[at] = [len(m) // 4 for m in more]
            ids = np.insert(ids, np.repeat(stops[at], lengths[at]), np.frombuffer(b"".join(more), np.uint32))
        return ids, lengths


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The columns of all batches, documents of three quarters of ``PIECE`` bytes of text or more at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        for part in byte_chunks(sizes.tolist(), PIECE // 4):
            held.append(batch.slice(part.start, part.stop - part.start))
            size += int(sizes[part].sum())
            if size >= PIECE // 4 * 3:
                yield tuple(pa.concat_arrays([h.column(c) for h in held]) for c in ("id", "text"))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([h.column(c) for h in held]) for c in ("id", "text"))


def write_token_blocks(
    docs: DataFrame,
    path: str,
    json_text: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_id: int = 2,
) -> None:
    """Write the ids of all documents, ``end_id`` after each, as blocks below ``path``.

    Documents are in ascending order of id, null ids first; rows with one id in order of a hash of their
    text, then of the text; repeated rows all stay. Null and empty texts give the end id alone. Other columns
    are not read. An empty table gives no blocks.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(json_text)
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WordTokenizer.of(shipped.value)
        limit = max(made.limit, end_id + 1)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        runs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, first, held
            names, lengths = pa.concat_arrays(keys), np.concatenate(sizes)
            row = {
                "part": pa.array([part], pa.int32()),
                "seq": pa.array([seq], pa.int32()),
                "first": pa.array([first], pa.int64()),
                "n_ids": pa.array([held], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                "lengths": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths, pa.int64())),
                "block": pa.array([encode_block(np.concatenate(runs), limit)], pa.binary()),
            }
            seq, first, held = seq + 1, first + held, 0
            for gathered in (keys, runs, sizes):
                gathered.clear()
            return pa.RecordBatch.from_pydict(row)

        for names, texts in _pieces(batches):
            ids, lengths = made.encode(texts)
            pa.default_memory_pool().release_unused()  # a worker would keep its largest piece's memory
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            stops = np.concatenate([[0], np.cumsum(lengths)])
            at = 0
            while at < len(lengths):
                # Documents until the block is full, or all that are left.
                upto = min(len(lengths), max(at + 1, int(np.searchsorted(stops, stops[at] + BLOCK_IDS - held))))
                keys.append(names.slice(at, upto - at))
                runs.append(ids[stops[at] : stops[upto]])
                sizes.append(lengths[at:upto])
                held += int(stops[upto] - stops[at])
                at = upto
                if held >= BLOCK_IDS:
                    yield flush()
        if runs:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sign"))
    ordered = rows.repartitionByRange("id", "sign").sortWithinPartitions("id", "sign", "text")
    schema = f"part int, seq int, first bigint, n_ids bigint, doc_ids array<{kind}>, lengths array<bigint>, block binary"
    ordered.select("id", "text").mapInArrow(blocks, schema).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str, id_col: str = "doc_id", *, with_ids: bool = False) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, and ``ids`` if asked for) of each document written.

    Read from the blocks alone: ``start`` counts the ids of all documents before, ``ids_crc32`` is taken over
    the document's ids as little-endian 32-bit integers. A damaged block raises CorruptBlock.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per task of the writing job.
    base = F.broadcast(sizes.select(F.col("part").alias("_part"), before.alias("base")))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, keys, lengths, block in zip(batch["start"], batch["doc_ids"], batch["lengths"], batch["block"]):
                ids = decode_block(block)
                stops = np.cumsum(np.asarray(lengths, np.int64))
                begins = stops - np.asarray(lengths, np.int64)
                data = memoryview(ids.tobytes())
                out = pd.DataFrame({"id": pd.Series(list(keys), dtype=object), "start": start + begins, "n_tokens": stops - begins})
                out["ids_crc32"] = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, stops)]
                if with_ids:
                    out["ids"] = [ids[a:b] for a, b in zip(begins, stops)]
                yield out

    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return (
        blocks.join(base, F.col("part") == F.col("_part"))
        .select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "lengths", "block")
        .mapInPandas(documents, schema)
        .withColumnRenamed("id", id_col)
    )


def ids_of(texts: Sequence[str | None], json_text: str) -> list[list[int]]:
    ids, lengths = WordTokenizer.of(json_text).encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
