"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. Three
neighbouring letters of a word (blanks at its ends count as a letter) are bound into a
vector by rotating the first twice, the second once, and multiplying; a text is the sum of
its bound vectors, and a language is the sum of the unit vectors of its documents. A
document is of the language whose prototype has the highest cosine with it. The common
mean of the prototypes is taken off both sides, so that grams that all languages share do
not blur the comparison.

Prototypes are learned from at most ``SAMPLE_ROWS`` rows, those of the smallest hashed ids
with a language. They are the only thing sent to the tasks: ``DIMENSIONS`` numbers for each
learned language. Every whole text is compared.

Defined results: a text that is NULL or has no letter is ``und`` with score 0; so is every
text if nothing was learned. Ties go to the language that sorts first. Repeated rows each
give a row, an empty table an empty one. A NULL id is not held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.session import materialize

DIMENSIONS = 1024
SAMPLE_ROWS = 8_000
HELD_OUT_FOLDS = 4
HELD_OUT = 2
SEED = 29
SHARPNESS = 12.0
# Working memory of a task; results do not depend on them.
SLICE_CHARS = 1_000_000
BLOCK_GRAMS = 4_096
UNKNOWN = "und"
GAP = 32


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % HELD_OUT_FOLDS


@lru_cache(maxsize=None)
def letter_vector(code: int) -> np.ndarray:
    random = np.random.default_rng([SEED, code])
    return (random.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Code point to itself for letters, else to the blank."""
    points = np.arange(0x110000)
    table = np.full(0x110000, GAP, np.int64)
    letters = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()]
    table[letters] = points[letters]
    return table


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, index into grams, count) of the three-letter grams, and the grams.

    A gram packs three code points of 21 bits.
    """
    joined = "".join(f" {t.lower()} " for t in texts)
    sizes = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    codes = _letter_table()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP) | (owner[1:] != owner[:-1])
    codes, owner = codes[kept], owner[kept]
    packed = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    whole = (owner[:-2] == owner[2:]) & (codes[1:-1] != GAP)
    packed, owner = packed[whole], owner[:-2][whole]
    grams, at = np.unique(packed, return_inverse=True)
    keys, counts = np.unique(owner * max(len(grams), 1) + at, return_counts=True)
    return keys // max(len(grams), 1), keys % max(len(grams), 1), counts, grams


def bound_vectors(grams: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each gram."""
    letters = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF])
    codes, at = np.unique(letters, return_inverse=True)
    at = at.reshape(letters.shape)
    table = np.stack([letter_vector(int(c)) for c in codes])
    return np.roll(table, 2, axis=1)[at[0]] * np.roll(table, 1, axis=1)[at[1]] * table[at[2]]


def text_vectors(texts: list[str]) -> np.ndarray:
    """The sum of the bound vectors of each text, with unit length where it is not zero."""
    rows, columns, counts, grams = gram_counts(texts)
    total = np.zeros((len(texts), DIMENSIONS), np.float32)
    for begin in range(0, len(grams), BLOCK_GRAMS):
        end = min(begin + BLOCK_GRAMS, len(grams))
        part = (columns >= begin) & (columns < end)
        block = np.zeros((len(texts), end - begin), np.float32)
        block[rows[part], columns[part] - begin] = counts[part]
        total += block @ bound_vectors(grams[begin:end]).astype(np.float32)
    return unit(total)


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def learn_prototypes(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
                     text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The sum of the unit vectors of the sampled documents of each language."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & F.col("doc_id").isNotNull() & (fold("doc_id") != HELD_OUT))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids, so the broadcast is bounded by the parameter.
    sample = known.join(F.broadcast(materialize(chosen, "chosen")), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, read = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for begin, end in _slices(read):
                vectors = text_vectors(read[begin:end])
                for lang in np.unique(langs[begin:end]):
                    total = vectors[langs[begin:end] == lang].sum(axis=0, dtype=np.float64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([str(lang)] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                        pa.array(total)], ["lang", "place", "value"])

    sums = sample.mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(
        F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["value"]
    return found


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray],
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (a soft maximum of the cosines) and ``cosine``."""
    langs = sorted(prototypes)
    table = unit(np.stack([prototypes[x] for x in langs])) if langs else np.zeros((0, DIMENSIONS))
    common = table.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    table = unit(table - common).astype(np.float32)
    common = common.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in _slices(texts):
                vectors = text_vectors(texts[begin:end])
                blank = ~vectors.any(axis=1)
                n = end - begin
                if langs:
                    cosines = (unit(vectors - common) @ table.T).astype(np.float64)
                    best = cosines.argmax(axis=1)
                    soft = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                    score = 1 / soft.sum(axis=1)
                    names = [UNKNOWN if b else langs[i] for i, b in zip(best, blank)]
                    cosine = cosines[np.arange(n), best]
                else:
                    names, score, cosine = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, n), pa.array(names, pa.string()),
                    pa.array(np.where(blank, 0.0, score)), pa.array(np.where(blank, 0.0, cosine))],
                    ["doc_id", "lang_pred", "score", "cosine"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, cosine double")


def identify_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``cosine`` of every document."""
    predicted = predict_language(docs, learn_prototypes(docs, rows))
    held_out = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    return predicted.select("doc_id", held_out, "lang_pred", "score", "cosine")
