"""SentencePiece encoding and decoding as a shortest path through a composed transducer.

The machine is compiled from a model file: a normaliser (dummy prefix, blanks to U+2581), a lexicon of
pieces, and byte fallback for characters that no piece has. For a merge model (BPE) the lexicon is composed
with an acceptor over neighbouring pieces: an arc from piece a to piece b weighs nothing if merging the two
strings together gives a, b again, and infinity otherwise. A segmentation is the one that merging gives
exactly if all its neighbours pass, so the only path of finite weight through the composition with an input
is the model's own encoding. It also follows that one piece at most ends any prefix of the input with finite
weight: the tropical shortest path keeps one state per position, and its time is linear in the text.

No piece holds a blank after another character, and none holds a line end, so inputs are cut there and the
paths of segments are joined. Paths of segments are kept per Python worker, up to ``MEMO`` segments and ``WORD_MEMO`` words of them, as packed numbers.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ledgerlens.llm.common import worker_state

BLANK = "\u2581"
MEMO, WORD_MEMO, PAIR_MEMO = 100_000, 600_000, 300_000  # entries of 100 to 180 bytes per worker
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
START = -1


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def _run_text(run: bytes) -> str:
    """A byte run as text; a byte that begins no whole character becomes U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out = []
        while run:
            for size in range(1, 5):
                try:
                    out.append(run[:size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    pass
            else:
                size = 1
                out.append("\ufffd")
            run = run[size:]
        return "".join(out)


class PieceTransducer:
    """The compiled machine; it holds strings and numbers only, so it can travel to the tasks."""

    def __init__(self, model_path: str):
        import sentencepiece

        with open(model_path, "rb") as file:
            model = file.read()
        normaliser = dict(_fields(dict(_fields(model)).get(3, b"")))
        if normaliser.get(2):
            raise ValueError("models with a character map are not supported")
        self.prefix = bool(normaliser.get(3, 1))
        if normaliser.get(4, 1):
            raise ValueError("models that drop repeated blanks are not supported")
        trainer = dict(_fields(dict(_fields(model)).get(2, b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("only merge (BPE) models are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.unknown = sp.unk_id()
        self.bytes = {}
        self.ids, self.scores = {}, {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("pieces that run over blanks or line ends are not supported")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # What each id shows; bytes below 128 are characters of their own, whatever is beside them.
        self.shown = ["" if sp.is_control(i) else p for i, p in enumerate(self.pieces)]
        for i, byte in self.byte_of.items():
            self.shown[i] = chr(byte) if byte < 128 else ""
        high = [i for i, byte in self.byte_of.items() if byte >= 128] or [-1]
        self.high = (min(high), max(high))

    # -- the acceptor over neighbouring pieces ---------------------------------

    def _merged(self, text: str) -> list[str]:
        """The model's merges on a short string: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.scores.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            scored = [(-s, i) for s, i in scored if s is not None]
            if not scored:
                break
            at = min(scored)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _passes(self, memo: dict, left: int, right: int) -> bool:
        """Whether the arc from piece ``left`` to piece ``right`` has weight 0; ``left`` is START at the start."""
        if len(memo) > PAIR_MEMO:
            memo.clear()
        pieces = [self.pieces[right]] if left == START else [self.pieces[left], self.pieces[right]]
        found = memo[left * len(self.pieces) + right] = self._merged("".join(pieces)) == pieces
        return found

    def _lexicon(self):
        """The automaton that tells which pieces end at each position of a string."""
        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, (i, len(piece)))
        found.make_automaton()
        return found

    # -- composition with an input ---------------------------------------------

    def _path(self, segment: str, state: dict) -> bytes:
        """Ids of the shortest path through ``segment``, as 32-bit numbers."""
        pairs, size = state["pairs"], len(self.pieces)
        # For each position, the piece that ends there on the path of weight 0. Without one the character
        # before it is in no piece: nothing merges across it, so what follows begins afresh.
        ends = [START] * (len(segment) + 1)
        lengths = [0] * (len(segment) + 1)
        for at, (piece, length) in state["lexicon"].iter(segment):
            if not lengths[at + 1]:
                left = ends[at + 1 - length]
                passes = pairs.get(left * size + piece)
                if passes is None:
                    passes = self._passes(pairs, left, piece)
                if passes:
                    ends[at + 1], lengths[at + 1] = piece, length
        out, at = [], len(segment)
        while at:
            if lengths[at]:
                out.append(ends[at])
                at -= lengths[at]
                continue
            at -= 1
            if self.bytes:
                out.extend(self.bytes[b] for b in reversed(segment[at].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
        out.reverse()
        return array("i", out).tobytes()

    @classmethod
    def from_parts(cls, parts: dict) -> PieceTransducer:
        """The machine with the attributes ``parts``. They are plain values and travel by themselves, so that a worker
        need not find this class by its name."""
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made

    def encode_many(self, texts: Sequence[str | None], remembered: int = WORD_MEMO) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty text. The worker remembers the paths of ``remembered`` words."""
        state = worker_state("pieces")
        if state.get("of") != (len(self.pieces), self.pieces[-1]):
            state.update(of=(len(self.pieces), self.pieces[-1]), memo={}, after_blank={}, pairs={})
            state["lexicon"] = self._lexicon()
        memo, blank_memo = state["memo"], state["after_blank"]
        known = blank_memo.get
        newline = self._path("\n", state)

        def segment(text: str) -> bytes:
            found = memo.get(text)
            if found is None:
                found = self._path(text, state)
                if len(text) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[text] = found
            return found

        def lines(text: str, ids: bytearray) -> None:
            for number, line in enumerate(text.split("\n")):
                if number:
                    ids += newline
                for part in SEGMENT.findall(line):
                    ids += segment(part)

        def after_blank(word: str) -> bytes:
            path = self._path(BLANK + word, state)
            if len(word) <= 64:
                if len(blank_memo) >= remembered:
                    blank_memo.clear()
                blank_memo[word] = path
            return path

        out = []
        for text in texts:
            ids = bytearray()
            if text:
                marked = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
                words = marked.split(BLANK)
                if words[0] or "" in words[1:]:
                    lines(marked, ids)
                    out.append(np.frombuffer(bytes(ids), np.int32))
                    continue
                for word in words[1:]:
                    found = known(word)
                    if found is not None:
                        ids += found
                    elif "\n" in word:
                        head, *rest = word.split("\n")
                        ids += known(head) or after_blank(head)
                        for part in rest:
                            ids += newline
                            if part:
                                ids += segment(part)
                    else:
                        ids += after_blank(word)
            out.append(np.frombuffer(bytes(ids), np.int32))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``."""
        numbers = np.asarray(ids, np.int64)
        if ((numbers >= self.high[0]) & (numbers <= self.high[1])).any():
            out, run = [], bytearray()
            for i in numbers.tolist():
                byte = self.byte_of.get(i)
                if byte is not None:
                    run.append(byte)
                    continue
                if run:
                    out.append(_run_text(bytes(run)))
                    run.clear()
                out.append(self.shown[i])
            out.append(_run_text(bytes(run)))
            joined = "".join(out)
        else:
            joined = "".join(map(self.shown.__getitem__, numbers.tolist()))
        if self.prefix and joined.startswith(BLANK):
            joined = joined[1:]
        return joined.replace(BLANK, " ")


def encode_pieces(
    docs: DataFrame,
    machine: PieceTransducer,
    text_col: str = "text",
    *,
    decoded: bool = False,
    remembered: int = WORD_MEMO,
) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_ids`` and ``round_trip``, and ``decoded`` if asked for.

    ``round_trip`` says whether decoding the ids gives the text back; a null text counts as empty. A text
    with U+2581 in it does not, as that character stands for a blank. Null and empty texts have no ids.
    Columns of ``docs`` with these names are replaced, all others pass through unchanged; repeated rows
    stay, an empty table stays empty. The machine travels as a broadcast of the model's size. ``remembered``
    bounds the word paths a worker keeps (about 180 bytes each); it trades memory for time, ids do not change.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vars(machine))
    made = ["ids", "n_ids", "round_trip", *(["decoded"] if decoded else [])]
    kept = docs.drop(*made)

    def run(batches):
        made = PieceTransducer.from_parts(shipped.value)
        for batch in batches:
            # Batches hold many long texts; smaller parts keep the lists of ids small.
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256].copy()
                texts = [t or "" for t in part[text_col]]
                ids = made.encode_many(texts, remembered)
                back = [made.decode(i) for i in ids]
                part["ids"] = pd.Series(ids, index=part.index, dtype=object)
                part["n_ids"] = [len(i) for i in ids]
                part["round_trip"] = [a == b for a, b in zip(texts, back)]
                if decoded:
                    part["decoded"] = back
                yield part

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    schema = [*fields, "ids array<int>", "n_ids bigint", "round_trip boolean", *(["decoded string"] if decoded else [])]
    return kept.mapInPandas(run, ", ".join(schema))


def decode_pieces(docs: DataFrame, machine: PieceTransducer, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of ``ids_col``; null for null ids, empty for none."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(machine))
    kept = docs.drop("decoded")

    def run(batches):
        made = PieceTransducer.from_parts(shipped.value)
        for batch in batches:
            back = [None if i is None else made.decode(list(i)) for i in batch[ids_col]]
            yield batch.assign(decoded=pd.Series(back, index=batch.index, dtype=object))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInPandas(run, ", ".join([*fields, "decoded string"]))
