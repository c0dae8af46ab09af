"""Repeated passages of running text, wherever lines begin and end.

A window is a run of ``PASSAGE_WORDS`` words (lower case in ASCII, any white space between
them). Of every window one anchor is chosen, the run of ``ANCHOR_WORDS`` words in it with the
least hash (winnowing), so equal windows have equal anchors. Only windows whose anchor
occurs at two places or more are gathered, and those whose own hash does are repeated. Every
run of as many equal words is found, in the middle of a line or across lines, and no pair is
formed. (Hashes have 64 bits: of n windows gathered, two different ones pass for equal with
a probability below n * n / 2**65.)

Neighbouring windows with neighbouring first occurrences are one passage. The first
occurrence, by id and place, stays. In its own text a window does not repeat one that it
overlaps.

Defined results: NULL texts and texts with fewer words have no passages; rows with a NULL id
are not searched. Places count code points, ends are exclusive. Of rows of one id, equal
places count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.names import free_name
from ledgerlens.session import Scratch, materialize

PASSAGE_WORDS = 25
ANCHOR_WORDS = 12
SLICE_CHARS = 750_000
# The filter of anchors has 16 to 32 bits for each, within these powers of two; results do not depend on it.
FILTER_BITS = (16, 27)

# Bytes of a word that are hashed by sums.
SHORT_WORD = 32

_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 2 ** 64)
# A number for every byte, the same for both cases of an ASCII letter; 0 for white space.
_LETTERS = np.random.default_rng(29).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B]
_LETTERS[[0x20, *range(0x09, 0x0E)]] = 0


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _runs(sums: np.ndarray, back: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words, from sums of word times power."""
    n = len(sums) - k
    return _mix((sums[k:] - sums[:n]) * back[:n])


@lru_cache(maxsize=2)
def _kept_powers(base: int) -> np.ndarray:
    return _powers(base, 1 << 20)


def _first_powers(base: int, n: int) -> np.ndarray:
    """The powers from 0 to n - 1; those for a usual slice are made once."""
    return _kept_powers(base)[:n] if n <= 1 << 20 else _powers(base, n)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:len(values) - step], values[step:])
        span += step
    return values


@dataclass
class Windows:
    """Words and windows of several texts, in bytes as the texts stand one after the other.

    ``begin`` is the byte where a text begins, ``first`` its first word, ``start`` and ``end`` are those of
    every word, ``sums`` of word hashes times power. A window has its text (``owner``), its first word (``at``)
    and its anchor.
    """

    raw: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    anchor: np.ndarray

    def keys(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the windows that begin at these words."""
        back = _first_powers(_BACK, len(self.sums))
        return _mix((self.sums[at + PASSAGE_WORDS] - self.sums[at]) * back[at])

    def places(self) -> np.ndarray:
        """The number of code points before every byte."""
        return np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])


def _word_hashes(data: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every word from its bytes times power; long words, for which that is weaker, have another one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * _first_powers(_FACTOR, len(raw)))])
    words = _mix((sums[end] - sums[start]) * _first_powers(_BACK, len(raw))[start])
    for i in np.flatnonzero(end - start > SHORT_WORD).tolist():
        words[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].lower())
    return words


def windows_of(texts: list[bytes | None]) -> Windows:
    data = b"".join(part for t in texts for part in (t or b"", b" "))
    raw = np.frombuffer(data, np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])[:-1].astype(np.int64)
    edges = np.diff((_LETTERS != 0)[raw].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words = _word_hashes(data, raw, start, end)
    first, total = np.searchsorted(start, begin), len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _first_powers(_FACTOR, total))])
    if total < PASSAGE_WORDS:
        none = np.zeros(0, np.int64)
        return Windows(raw, begin, first, start, end, sums, none, none, np.zeros(0, np.uint64))
    anchors = _runs(sums, _first_powers(_BACK, total), ANCHOR_WORDS)
    least = _least(anchors, PASSAGE_WORDS - ANCHOR_WORDS + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, total)))
    at = np.flatnonzero(owner[:total - PASSAGE_WORDS + 1] == owner[PASSAGE_WORDS - 1:])
    return Windows(raw, begin, first, start, end, sums, owner[at], at, least[at])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()).to_pylist()
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text or b"") > SLICE_CHARS:
            yield ids[begin:i], texts[begin:i]
            begin, size = i, 0
        size += len(text or b"")
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor of each stretch of windows that have the same; twice if the stretch has several places of it.

    Windows with one place of an anchor are at most ``PASSAGE_WORDS - ANCHOR_WORDS + 1``. In a
    stretch of no more, no window repeats another that it does not overlap.
    """
    for batch in batches:
        for _, texts in _slices(batch):
            found = windows_of(texts)
            anchor, owner = found.anchor, found.owner
            change = np.ones(len(anchor), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(change)
            several = np.diff(np.append(begin, len(anchor))) > PASSAGE_WORDS - ANCHOR_WORDS + 1
            once = anchor[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([once, once[several]]).view(np.int64))], ["anchor"])


def _gathered(bits: int, filled):
    """Windows whose anchor may be shared: ``key``, ``doc_id``, ``at``, ``end`` and ``own``.

    ``at`` is the number of the first word and its place in the text, 32 bits each. Only the
    first of equal windows of a text has their common key. Its ``own`` is -2 if another
    follows behind it and -1 if not; that of the others is the first one's ``at``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filled.value
        for batch in batches:
            for ids, texts in _slices(batch):
                found = windows_of(texts)
                slot = (found.anchor & np.uint64((1 << bits) - 1)).astype(np.int64)
                hit = (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                owner, at_word = found.owner[hit], found.at[hit]
                if not len(owner):
                    continue
                key, word = found.keys(at_word), at_word - found.first[owner]
                places, zero = found.places(), found.begin[owner]
                start = places[found.start[at_word]] - places[zero]
                end = places[found.end[at_word + PASSAGE_WORDS - 1]] - places[zero]
                at = (word << 32) | start
                first = np.arange(len(key))
                # Only where a text may have a window twice, its windows are put in order.
                mixed = key ^ _mix(owner.astype(np.uint64) * np.uint64(_FACTOR))
                ranked = np.sort(mixed)
                twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
                some = np.flatnonzero(np.isin(mixed, twice)) if len(twice) else np.zeros(0, np.int64)
                if len(some):
                    order = some[np.lexsort((word[some], key[some], owner[some]))]
                    same = np.zeros(len(order), bool)
                    same[1:] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                    first[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = first != np.arange(len(key))
                apart = later & (word >= word[first] + PASSAGE_WORDS)
                own = np.full(len(key), -1, np.int64)
                own[first[apart]] = -2
                own[apart] = at[first[apart]]
                spread = _mix(key + (ids[owner].astype(np.uint64) * np.uint64(_BACK)) + at.view(np.uint64) * np.uint64(_FACTOR))
                key = np.where(later, spread, key)
                kept = apart | ~later
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[kept].view(np.int64)), pa.array(ids[owner][kept]), pa.array(at[kept]),
                     pa.array(end[kept].astype(np.int32)), pa.array(own[kept])],
                    ["key", "doc_id", "at", "end", "own"])

    return run


def _filter(shared: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of a slot, and the table with a bit for the slot of every shared anchor."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * shared.count()).bit_length()))
    slots = shared.select(F.expr(f"anchor & {(1 << bits) - 1}L").alias("slot"))
    found = slots.groupBy(F.expr("shiftright(slot, 6)").alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits, table


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every passage that occurs elsewhere: ``doc_id``, ``start``, ``end``, ``cluster_doc_id`` and
    ``cluster_start`` (its first occurrence, which stays) and ``removed``.

    A stretch of text with several first occurrences gives several rows, which may overlap.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null and text is not null")
    with Scratch(docs.sparkSession) as scratch:
        shared = scratch.keep(texts.mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(
            F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
        bits, table = _filter(shared)
        filled = docs.sparkSession.sparkContext.broadcast(table)
        windows = texts.mapInArrow(
            _gathered(bits, filled), "key long, doc_id long, at long, end int, own long")
        if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
            windows = windows.dropDuplicates(["key", "doc_id", "at"])
        # Rows come in order, so that a key with many of them is never held in memory.
        of_key = Window.partitionBy("key").orderBy("doc_id", "at")
        upto = of_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = windows.withColumns({
            "first_doc": F.first("doc_id").over(upto), "first_at": F.first("at").over(upto),
            "number": F.row_number().over(of_key), "follows": F.lead("doc_id").over(of_key)})
        source = {"source": F.when(F.col("own") >= 0, F.col("doc_id")).otherwise(F.col("first_doc")),
                  "source_at": F.when(F.col("own") >= 0, F.col("own")).otherwise(F.col("first_at"))}
        repeated = placed.where("number > 1 or follows is not null or own <> -1").withColumns(source)
        word = F.shiftright("at", 32)
        lines = repeated.select("doc_id", "at", "end", "source", "source_at",
                                (word - F.shiftright("source_at", 32)).alias("ahead"))
        run = Window.partitionBy("doc_id", "source", "ahead").orderBy("at")
        spans = lines.withColumn("run", word - F.row_number().over(run)).groupBy(
            "doc_id", "source", "ahead", "run").agg(
            F.min("at").alias("at"), F.max("end").alias("end"), F.min("source_at").alias("source_at"))
        place = lambda name: F.expr(f"cast({name} & {2 ** 32 - 1}L as int)")
        found = materialize(spans.select(
            "doc_id", place("at").alias("start"), "end", F.col("source").alias("cluster_doc_id"),
            place("source_at").alias("cluster_start"),
            ((F.col("doc_id") != F.col("source")) | (F.col("at") != F.col("source_at"))).alias("removed")), "passages")
        filled.unpersist()
        return found


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed passages taken out of their texts; all columns stay, whatever their names."""
    owner, taken = free_name(docs, "passage_doc_id"), free_name(docs, "passage_places")
    places = repeated_passages(docs, id_col, text_col).where("removed").groupBy(
        F.col("doc_id").alias(owner)).agg(F.sort_array(F.collect_set(
            F.struct("start", "end"))).alias(taken))
    joined = docs.join(places, F.col(id_col).cast("long") == F.col(owner), "left")
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("done"))
    kept = F.aggregate(taken, state, lambda x, p: F.struct(
        F.concat(x["text"], F.substring(F.col(text_col), x["done"] + 1, F.greatest(p["start"] - x["done"], F.lit(0)))).alias("text"),
        F.greatest(x["done"], p["end"]).alias("done")),
        lambda x: F.concat(x["text"], F.substring(F.col(text_col), x["done"] + 1, F.length(text_col))))
    text = F.when(F.col(taken).isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, text).drop(owner, taken)
