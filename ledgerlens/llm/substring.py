"""Removal of repeated passages: paragraphs joined by MinHash bands.

A paragraph is a line of a text with at least ``MIN_WORDS`` words. Equal paragraphs (by their
set of five-word shingles) are one entry. Every entry has a MinHash sketch cut into bands;
the number and length of the bands are tuned so that a pair at the threshold collides with
at least the asked recall. Entries that share a band are compared by the exact Jaccard
similarity of their shingles: first with the best connected one of the band, then those pairs
that may be similar by what they differ in from the middle of their group. Links form
components: of each, the first paragraph stays and the others are removals. Texts are cut
and hashed twice: for places and bands, and for the shingles of the entries to compare.

Defined results: NULL and empty texts have no paragraphs. Places count code points, ends are
exclusive. Of equal or linked paragraphs the one of the smallest id, then line, stays; rows
with a NULL id are not searched and not changed. Rows of one id count as one document. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.differences import possible_pairs
from ledgerlens.llm.jaccard import PERCENT, shingle_sets
from ledgerlens.llm.names import free_name
from ledgerlens.llm.settling import placed_members, settle, with_components
from ledgerlens.session import Scratch, materialize

MIN_WORDS = 20
RECALL = 0.998
MOST_HASHES = 96
SLICE_CHARS = 750_000
# Entries of candidates are sent to every task up to this number (16 bytes each).
BROADCAST_ENTRIES = 500_000
SEED = 53


def tuned_bands(percent: int = PERCENT, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows in a band): the longest bands that reach the recall within the hashes."""
    for rows in range(12, 0, -1):
        miss = 1 - (percent / 100) ** rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss))) if miss > 0 else 1
        if bands * rows <= MOST_HASHES:
            return bands, rows
    return MOST_HASHES, 1


def paragraphs_of(text: str | None) -> list[tuple[int, int, int]]:
    """(line, start, end) of the lines that have enough words."""
    found, start = [], 0
    for line, part in enumerate((text or "").split("\n")):
        if len(part.encode().split()) >= MIN_WORDS:
            found.append((line, start, start + len(part)))
        start += len(part) + 1
    return found


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of band keys for each set; the sets are not empty."""
    bands, rows = tuned_bands()
    random = np.random.default_rng(SEED)
    factors = random.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    terms = random.integers(0, 2 ** 63, bands * rows, dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = np.zeros((len(sizes), bands), np.uint64)
    spread, shifted = np.empty_like(hashes), np.empty_like(hashes)
    for i, (factor, term) in enumerate(zip(factors, terms)):
        np.multiply(hashes, factor, out=spread)
        spread += term
        np.right_shift(spread, np.uint64(29), out=shifted)
        spread ^= shifted
        spread *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(spread, starts)
        band = i // rows
        keys[:, band] = (keys[:, band] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
    return keys


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text or "") > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[list, list[tuple[int, int, int]], list[str]]]:
    """Ids, places and texts of the paragraphs, slice by slice."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for begin, end in _slices(texts):
        owners, places, parts = [], [], []
        for i in range(begin, end):
            for place in paragraphs_of(texts[i]):
                owners.append(ids[i])
                places.append(place)
                parts.append(texts[i][place[1]:place[2]])
        if parts:
            yield owners, places, parts


def _entries(parts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The fingerprint of each paragraph's shingle set, the hashes and the sizes."""
    sets = shingle_sets([p.encode() for p in parts])
    at = sets.starts
    prints = [xxhash.xxh3_128_digest(sets.hashes[at[i]:at[i + 1]].tobytes()) for i in range(len(parts))]
    return prints, sets.hashes, sets.sizes


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for owners, places, parts in _cut(batch):
            lines, starts, ends = zip(*places)
            prints, hashes, sizes = _entries(parts)
            keys = band_keys(hashes, sizes)
            offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(owners, pa.int64()), pa.array(lines, pa.int32()), pa.array(starts, pa.int32()),
                pa.array(ends, pa.int32()), pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))],
                ["doc_id", "line", "start", "end", "node", "bands"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, parts in _cut(batch):
            prints, hashes, sizes = _entries(parts)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], ["node", "elements"])


def _candidates(scratch: Scratch, places: DataFrame) -> DataFrame:
    """``band`` and ``node`` of the bands that several entries share; an entry's copies count once."""
    entries = places.groupBy("node").agg(F.first("bands").alias("bands"))
    bands = entries.select("node", F.explode("bands").alias("band"))
    counted = bands.withColumn("n", F.count("*").over(Window.partitionBy("band")))
    met = scratch.keep(counted.where("n > 1").select("band", "node"), "shared")
    fame = met.groupBy("node").agg(F.count("*").alias("fame"))
    return placed_members(scratch, met.join(fame, "node"), ["band"])


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every paragraph that has an equal or similar one: ``doc_id``, ``line``, ``start``, ``end``,
    ``cluster_doc_id`` and ``cluster_line`` (the paragraph that stays), ``cluster_size`` and ``removed``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null and text is not null")
    with Scratch(docs.sparkSession) as scratch:
        places = scratch.keep(texts.mapInArrow(
            _places, "doc_id long, line int, start int, end int, node binary, bands array<long>"), "places")
        members = _candidates(scratch, places)
        places = places.drop("bands")

        wanted = scratch.keep(members.select("node").distinct(), "wanted")
        few = wanted.count() <= BROADCAST_ENTRIES
        stored = scratch.keep(texts.mapInArrow(_lists, "node binary, elements array<long>").join(
            F.broadcast(wanted) if few else wanted, "node").dropDuplicates(["node"]), "elements")
        one = stored.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
        two = stored.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
        sizes = F.size("set_a") + F.size("set_b")

        def verify(pairs: DataFrame) -> DataFrame:
            # Unless the sizes are near, the sets are not read.
            near = F.least(F.size("set_a"), F.size("set_b")) * 100 >= F.greatest(
                F.size("set_a"), F.size("set_b")) * PERCENT
            shared = F.size(F.array_intersect("set_a", "set_b"))
            both = pairs.join(one, "a").join(two, "b").where(near)
            return scratch.keep(both.where(shared * (100 + PERCENT) >= sizes * PERCENT).select("a", "b"), "links")

        def narrow(open_members: DataFrame) -> tuple[DataFrame, DataFrame]:
            nodes = scratch.keep(open_members.select("node").distinct(), "nodes")
            return possible_pairs(scratch, stored.join(nodes, "node"), open_members, ["band"], PERCENT)

        none = members.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
        labels = settle(scratch, members, ["band"], none, verify, narrow=narrow, best_first=False)
        named = scratch.keep(with_components(places, labels).drop("node"), "named")
        clusters = scratch.keep(named.groupBy("component").agg(
            F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("cluster_size")
        ).where("cluster_size > 1"), "clusters")
        found = named.join(clusters, "component").select(
            "doc_id", "line", "start", "end", F.col("first.doc_id").alias("cluster_doc_id"),
            F.col("first.line").alias("cluster_line"), "cluster_size",
            ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line"))).alias("removed"))
        return materialize(found, "repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; all columns stay, whatever their names."""
    owner, places = free_name(docs, "repeat_doc_id"), free_name(docs, "repeat_lines")
    lines = repeated_paragraphs(docs, id_col, text_col).where("removed").groupBy(
        F.col("doc_id").alias(owner)).agg(F.collect_set("line").alias(places))
    joined = docs.join(lines, F.col(id_col).cast("long") == F.col(owner), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"),
                                 lambda x, i: ~F.array_contains(places, i)), "\n")
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, text).drop(owner, places)
