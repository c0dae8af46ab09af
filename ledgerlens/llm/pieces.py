"""SentencePiece encoding and decoding by a Viterbi search shared between words.

A text is marked as the model wants it and cut into words where no piece can reach across.
The distinct words of a slice of documents are sorted, which lays out their trie
depth-first: each word keeps the forward states of the prefix it shares with the word
before and goes on from there. The pieces of a word are then read backwards.

An arc of the lattice is a piece. In a unigram model the best sum of scores wins. In a BPE
model an arc is open only after a piece with which it stays unmerged, that is, if the
merges applied to the two alone leave them as they are. Exactly one arc into each place is
open then, and the path is the one that the merges produce, so ids equal those of the
SentencePiece library for either kind of model.

Defined results: NULL or empty text gives no pieces and decodes to the empty text. Rows
repeat as given; an empty table gives an empty one; extra columns are not read. Texts are
encoded whole. Characters without a piece become byte pieces, or the unknown piece if the
model has none. A literal U+2581 decodes to a space, as in the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Working-memory bounds of one Python worker; results do not depend on them.
SLICE_CHARS = 2_000_000
KEPT_WORDS = 500_000
KEPT_PAIRS = 1_000_000
UNKNOWN_PENALTY = 10.0
BPE = 2


class PieceModel:
    """Pieces, scores and rules of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models with identity normalization are supported")
        self.merging = model.trainer_spec.model_type == BPE
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [
            b"" if i in control else byte_of.get(i) or p.replace(MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.spelled[self.unknown] = " ⁇ ".encode()
        self.lowest = min((self.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in ends.items()}
        self.words = self._word_pattern()
        self.together: dict[int, bool] = {}

    def _word_pattern(self) -> re.Pattern | None:
        """Cuts a marked text where no piece of two characters or more can reach across."""
        long = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            return None
        inside = "".join(re.escape(c) for c in sorted({c for p in long for c in p} - {MARK}))
        if not inside:
            return re.compile(f"{MARK}+|[^{MARK}]+", re.DOTALL)
        return re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]+", re.DOTALL)

    def marked_words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.dummy_prefix:
            marked = MARK + marked
        return self.words.findall(marked) if self.words else [marked]

    def merged(self, text: str) -> list[str]:
        """The merges applied to a short text: highest score first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave two pieces side by side as they are."""
        if len(self.together) >= KEPT_PAIRS:
            self.together.clear()
        a, b = self.pieces[left], self.pieces[right]
        apart = self.merged(a + b) == [a, b]
        self.together[left * len(self.pieces) + right] = apart
        return apart

    def fallback(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8")]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; the space of the dummy prefix goes."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _last_arcs(model: PieceModel, word: str, end: int) -> Iterator[tuple[int, int]]:
    """Pieces that end at a place, as (begin, id), longest first."""
    lengths = model.lengths.get(word[end - 3:end], ()) if end > 2 else ()
    for length in (*lengths, 2, 1):
        if length <= end:
            piece = model.ids.get(word[end - length:end])
            if piece is not None:
                yield end - length, piece


def _best_arc(model: PieceModel, word: str, end: int, totals: list[float]) -> tuple[int, int]:
    """The arc of the highest score into a place; leaves its total behind."""
    token, start, best = -1, end - 1, totals[end - 1] + model.lowest
    if word[end - 1] in model.ids:
        best = -float("inf")
    for begin, piece in _last_arcs(model, word, end):
        total = totals[begin] + model.scores[piece]
        if total > best:
            token, start, best = piece, begin, total
    totals.append(best)
    return token, start


def encode_words(model: PieceModel, words: Iterable[str]) -> dict[str, bytes]:
    """Ids, as native 32-bit numbers, of each distinct word.

    ``tokens[i]``, ``starts[i]`` and ``totals[i]`` are the forward state at the place after
    ``i`` characters: the last piece (-1: a character without a piece), where it begins and,
    for a unigram model, the score so far.
    """
    ids, ends, together = model.ids, model.lengths, model.together
    merging, n_pieces = model.merging, len(model.pieces)
    tokens, starts, totals = [-1], [0], [0.0]
    found: dict[str, bytes] = {}
    before = ""
    for word in sorted(words):
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del tokens[shared + 1:], starts[shared + 1:], totals[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            token, start = -1, end - 1
            if merging:
                # As _best_arc, with the arcs written out: the only open one wins.
                lengths = ends.get(word[end - 3:end], ()) if end > 2 else ()
                for length in (*lengths, 2, 1):
                    begin = end - length
                    if begin < 0:
                        continue
                    piece = ids.get(word[begin:end])
                    if piece is None:
                        continue
                    left = tokens[begin]
                    if left >= 0:
                        apart = together.get(left * n_pieces + piece)
                        if apart is None:
                            apart = model.stay_apart(left, piece)
                        if not apart:
                            continue
                    token, start = piece, begin
                    break
            else:
                token, start = _best_arc(model, word, end, totals)
            tokens.append(token)
            starts.append(start)
        path, end = [], len(word)
        while end > 0:
            if tokens[end] >= 0:
                path.append(tokens[end])
            else:
                path.extend(reversed(model.fallback(word[end - 1])))
            end = starts[end]
        path.reverse()
        found[word] = array("i", path).tobytes()
        before = word
    return found


class Encoder:
    """Encodes texts slice by slice and keeps a bounded number of words between slices."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.model.marked_words(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        self.known |= encode_words(self.model, new)
        spelled = self.known.__getitem__
        return [np.frombuffer(b"".join(map(spelled, words)), np.int32) for words in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each model and Python worker."""
    return Encoder(path)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_CHARS`` characters; a longer text is one of its own."""
    begin = chars = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > begin and chars + size > SLICE_CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += size
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids`` and ``round_trip``: whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts):
                part = [t or "" for t in texts[begin:end]]
                found = work.encode(part)
                same = [work.model.decode(ids.tolist()) == t for ids, t in zip(found, part)]
                sizes = np.array([len(ids) for ids in found], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
                    pa.array(sizes), pa.array(same, pa.bool_()),
                ], ["doc_id", "ids", "n_ids", "round_trip"])

    id_type = docs.schema[id_col].dataType.simpleString()
    read = docs.select(id_col, text_col)
    return read.mapInArrow(run, f"doc_id {id_type}, ids array<int>, n_ids int, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; NULL ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = encoder(model).model
        for batch in batches:
            texts = [rules.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")
