"""Join of near-equal documents: Jaccard similarity of word shingles, by PartEnum signatures.

Sets whose similarity reaches the threshold differ in few elements. The domain of hashed
shingles is cut into first-level parts, so many that some part holds at most one
difference, and each of these into second-level parts; a signature is the content of a
first-level part without one of its second-level parts, so one of the enumerated subsets
is equal in both sets. Sets are compared inside bands of about equal size and across the
border of neighbouring bands, each with the number of parts that its sizes ask for.

Signatures only propose pairs; the similarity of each is computed from whole texts, so
none is lost and none is added. (Shingles are 64-bit hashes: of n shingles in two texts,
two different ones pass for equal with a probability below n * n / 2**65.)

Defined results: NULL, empty and blank texts have no shingles and stand alone; fewer than
five words are one shingle. Copies and rows of one id are linked. A row with a NULL id has
a NULL component and links nothing. Every input row gives one row; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.differences import possible_pairs
from ledgerlens.llm.names import free_name
from ledgerlens.llm.settling import placed_members, settle, with_components
from ledgerlens.session import Scratch, arrow_batches, materialize

SHINGLE_WORDS = 5
PERCENT = 80
# Second-level parts, and how many of them a signature leaves out.
SECOND_PARTS = 3
BAND_RATIO = 1.5
# Domain cuts that a set with too many empty signatures falls back to, one after the other.
CUTS = 4
# Texts of about so many characters are worked on at once.
SLICE_CHARS = 750_000
BUCKET_SHINGLES = 400_000
# Slices whose signatures are dealt to the buckets together (about 450,000); of one slice, many buckets would get one or two each.
PACKED_SLICES = 16
# Bounds above this are not needed to tell pairs apart.
MOST_SHARED = 100
# Ids of candidates are sent to every task up to this number (8 bytes each).
BROADCAST_IDS = 500_000
# Working-memory bounds of one task; results do not depend on them.
BUCKET_BOUND = 2_000_000
BATCH_ROWS = 1_000

# Stands for a step between ids that one byte cannot hold.
FAR_STEP = -128

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd multiplications."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2 ** 64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class ShingleSets:
    """Sorted distinct shingle hashes of several texts, one after the other."""

    hashes: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])


def _order(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """By owner, then hash; one sort by both where their first bits tell all hashes apart, else one by each."""
    if len(owner) and owner.max() < 1 << 24:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        sorted_hashes, sorted_owner = hashes[order], owner[order]
        if not ((sorted_hashes[1:] < sorted_hashes[:-1]) & (sorted_owner[1:] == sorted_owner[:-1])).any():
            return order
    return np.lexsort((hashes, owner))


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE_WORDS) -> ShingleSets:
    cut = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in cut], np.int64)
    total = int(counts.sum())
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(cut)), np.uint64, total)
    doc = np.repeat(np.arange(len(texts)), counts)
    n = max(total - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * _ODD + words[i:i + n]
    inside = doc[:n] == doc[k - 1:] if n else np.zeros(0, bool)
    hashes, owner = _mix(rolled[inside]), doc[:n][inside]
    begin = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = [np.uint64(xxhash.xxh3_64_intdigest(words[begin[i]:begin[i + 1]].tobytes(), seed=1)) for i in short]
        hashes = np.concatenate([hashes, np.array(whole, np.uint64)])
        owner = np.concatenate([owner, short])
    order = _order(hashes, owner)
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return ShingleSets(hashes[first], np.bincount(owner[first], minlength=len(texts)).astype(np.int64))


@dataclass(frozen=True)
class Comparison:
    """Sets of the sizes ``low`` to ``high`` that differ in at most ``differences`` elements."""

    number: int
    low: int
    high: int
    differences: int
    parts: int


def _parts(low: int, high: int, differences: int) -> int:
    """First-level parts: enough that sets of the band seldom lack full signatures.

    Sought is the least number with a margin of 2.5 deviations at either end and in the
    middle of the band, or else the number of the widest margin.
    """
    def margin(parts: int) -> float:
        found = []
        for size in (low, (low + high) // 2, high):
            lacking = parts * (3 * exp(-2 * size / parts / 3) - 2 * exp(-size / parts))
            sure = parts - min(differences, size // 4) // 2 - 1
            found.append((sure - lacking) / sqrt(max(lacking, 0.1)))
        return min(found)

    least = differences // 2 + 1
    tried = range(least, 3 * least + 8)
    return next((n for n in tried if margin(n) >= 2.5), max(tried, key=margin))


@lru_cache(maxsize=None)
def comparisons(size: int) -> tuple[Comparison, ...]:
    """The comparisons that a set of this size takes part in."""
    found = []
    for c in _comparisons_upto(1 << max(size, 64).bit_length()):
        if c.low <= size <= c.high and c.differences > 0:
            found.append(c)
    return tuple(found)


@lru_cache(maxsize=None)
def _comparisons_upto(size: int) -> tuple[Comparison, ...]:
    made, low, number = [], 1, 0
    apart = 100 - PERCENT
    while low <= size:
        high = max(low, int(low * BAND_RATIO))
        differences = 2 * high * apart // (100 + PERCENT)
        made.append(Comparison(number, low, high, differences, _parts(low, high, differences)))
        top = high * 100 // PERCENT
        bottom = -(-(high + 1) * PERCENT // 100)
        if top > high:
            differences = (high + top) * apart // (100 + PERCENT)
            made.append(Comparison(number + 1, bottom, top, differences, _parts(bottom, top, differences)))
        low, number = high + 1, number + 2
    return tuple(made)


def signatures(sets: ShingleSets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, 64-bit signature) for every signature, and a bound for every text.

    The bound says how many signatures a set shares at least with any set that is similar
    enough: its first-level parts with one difference at most, without those whose
    signatures may be empty.
    """
    rows = [(i, c) for i, size in enumerate(sets.sizes.tolist()) for c in comparisons(size)]
    texts, values = [], []
    bounds = np.full(len(sets.sizes), MOST_SHARED, np.int64)
    for cut in range(CUTS):
        if not rows:
            break
        text = np.array([i for i, _ in rows])
        number = np.array([c.number for _, c in rows], np.uint64)
        parts = np.array([c.parts for _, c in rows])
        sizes = sets.sizes[text]
        # A partner is at most 5/4 as large, so a set and its partner differ in at most a
        # quarter of its size; the other first-level parts hold one difference at most.
        apart = np.minimum(np.array([c.differences for _, c in rows]), sizes // 4)
        agreeing = parts - apart // 2
        row = np.repeat(np.arange(len(rows)), sizes)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(sets.starts[text], sizes)
        hashes = sets.hashes[at]
        place = _mix(hashes, 11 + cut)
        first = (place >> np.uint64(16)) % parts[row].astype(np.uint64)
        second = (place & np.uint64(0xFFFF)) % np.uint64(SECOND_PARTS)
        base = np.concatenate([[0], np.cumsum(parts)])
        cell = ((base[row] + first.astype(np.int64)) * SECOND_PARTS + second.astype(np.int64))
        sums = np.zeros(base[-1] * SECOND_PARTS, np.uint64)
        np.add.at(sums, cell, _mix(hashes, 5))
        filled = np.bincount(cell, minlength=len(sums)).reshape(-1, SECOND_PARTS) > 0
        sums = sums.reshape(-1, SECOND_PARTS)
        owner = np.repeat(np.arange(len(rows)), parts)
        lacking = np.bincount(owner, filled.sum(axis=1) < 2, minlength=len(rows))
        fails = lacking >= agreeing
        if cut == 0:
            sure = np.where(fails, 1, agreeing - lacking)
            np.minimum.at(bounds, text, np.maximum(sure, 1).astype(np.int64))
        part = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        salt = _mix((number[owner] * np.uint64(CUTS) + np.uint64(cut)) * np.uint64(1 << 32) + part)
        whole = sums.sum(axis=1, dtype=np.uint64)
        for left_out in range(SECOND_PARTS):
            rest = filled[:, [j for j in range(SECOND_PARTS) if j != left_out]].any(axis=1)
            # Only when no further cut is left do empty signatures count.
            keep = rest | (fails[owner] if cut == CUTS - 1 else False)
            content = (whole - sums[:, left_out])[keep]
            values.append(_mix(_mix(content + salt[keep], 21), left_out))
            texts.append(text[owner[keep]])
        rows = [r for r, bad in zip(rows, fails.tolist()) if bad]
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), bounds
    return np.concatenate(texts), np.concatenate(values), bounds


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text or b"") > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text or b"")
    if begin < len(texts):
        yield begin, len(texts)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sizes, prints = [], []
        for begin, end in _slices(texts):
            sets = shingle_sets(texts[begin:end])
            at = sets.starts
            sizes.extend(sets.sizes.tolist())
            prints.extend(xxhash.xxh3_128_digest(sets.hashes[at[i]:at[i + 1]].tobytes())
                          for i in range(end - begin))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())],
            ["doc_id", "n_shingles", "print"])


def _by_bucket(bits: int, value: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    bucket = (value & np.uint64((1 << bits) - 1)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    bucket, value, ids, bounds = bucket[order], value[order], ids[order], bounds[order]
    some, at = np.unique(bucket, return_index=True)
    offsets = pa.array(np.append(at, len(bucket)).astype(np.int32))
    low = (value >> np.uint64(bits)).astype(np.uint32).view(np.int32)
    # Ids follow each other by small steps of one byte; the others stand in a list of their own.
    steps = np.diff(ids, prepend=ids[:1])
    steps[at] = 0
    far = np.abs(steps.astype(np.float64)) >= -FAR_STEP
    small = np.where(far, FAR_STEP, steps).astype(np.int8)
    far_offsets = pa.array(np.append(0, np.cumsum(far))[np.append(at, len(bucket))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (low, bounds, small)]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), *lists[:2], pa.array(ids[at]), lists[2],
         pa.ListArray.from_arrays(far_offsets, pa.array(steps[far]))],
        ["bucket", "low", "bounds", "first", "steps", "far_steps"])


def _signature_rows(bits: int):
    """Signatures packed by bucket: one row for each bucket and ``PACKED_SLICES``, 6 bytes a signature.

    There are 2 ** ``bits`` buckets; 32 further bits of a signature tell it apart in its own. As buckets
    do not grow with the input, the share of those that differ and pass for equal, about one in 10,000,
    does not either; they only propose a pair more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                text, value, bounds = signatures(shingle_sets(texts[begin:end]))
                # In the order of the texts, as the ids of a table often ascend.
                order = np.argsort(text, kind="stable")
                text = text[order]
                parts.append((value[order], ids[begin:end][text], bounds[text].astype(np.int8)))
                if len(parts) >= PACKED_SLICES:
                    yield _by_bucket(bits, *(np.concatenate(p) for p in zip(*parts)))
                    parts = []
        if parts:
            yield _by_bucket(bits, *(np.concatenate(p) for p in zip(*parts)))

    return run


def bucket_bits(shingles: int) -> int:
    """Bits for buckets of about ``BUCKET_SHINGLES`` shingles."""
    return min(22, max(6, (shingles // BUCKET_SHINGLES).bit_length()))


def _as_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text as one list."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for begin, end in _slices(texts):
            sets = shingle_sets(texts[begin:end])
            offsets = pa.array(np.append(0, np.cumsum(sets.sizes)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(sets.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], ["doc_id", "shingles"])


def _listed(scratch: Scratch, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id`` and ``shingles`` of the wanted ids."""
    few = wanted.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text")
    return scratch.keep(found.mapInArrow(_shingle_lists, "doc_id long, shingles array<long>"), "shingles")


def _verified(scratch: Scratch, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of ids that are similar enough.

    The shingles of each text are listed once; pairs only meet the lists, and are counted in the JVM.
    """
    wanted = scratch.keep(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"), "wanted")
    stored = _listed(scratch, texts, wanted)
    one = stored.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    two = stored.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    shared, sizes = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    # 100 shared >= PERCENT (sizes - shared), and at least the smaller set is large enough for it.
    near = F.least(F.size("set_a"), F.size("set_b")) * 100 >= F.greatest(F.size("set_a"), F.size("set_b")) * PERCENT
    both = pairs.join(one, "a").join(two, "b").where(F.size("set_a") > 0).where(near)
    return scratch.keep(both.where(shared * (100 + PERCENT) >= sizes * PERCENT).select("a", "b").distinct(), "links")


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures that occur twice or more in their bucket; the rows come bucket by bucket.

    A bucket beyond the bound of working memory is passed on as it is; the count that
    follows sorts it out.
    """
    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], whole: bool) -> pa.RecordBatch:
        key, ids, bounds = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if whole:
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            keep = np.zeros(len(key), bool)
            keep[order[1:][same]] = True
            keep[order[:-1][same]] = True
            key, ids, bounds = key[keep], ids[keep], bounds[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(ids), pa.array(bounds)], ["key", "node", "bound"])

    open_bucket, parts, size, cut = -1, [], 0, False
    for batch in batches:
        buckets = batch.column(0).to_pylist()
        low, bounds, first, steps, far_steps = (batch.column(i) for i in range(1, 6))
        for row, bucket in enumerate(buckets):
            if parts and (bucket != open_bucket or size > BUCKET_BOUND):
                cut = bucket == open_bucket or cut
                yield flush(parts, not cut)
                parts, size, cut = [], 0, cut and bucket == open_bucket
            open_bucket = bucket
            moves = steps[row].values.to_numpy().astype(np.int64)
            moves[moves == FAR_STEP] = far_steps[row].values.to_numpy()
            ids = moves.cumsum() + first[row].as_py()
            key = (np.int64(bucket) << 32) | low[row].values.to_numpy().view(np.uint32)
            parts.append((key, ids, bounds[row].values.to_numpy()))
            size += len(key)
    if parts:
        yield flush(parts, not cut)


def _shared_signatures(scratch: Scratch, texts: DataFrame, profiles: DataFrame, firsts: DataFrame,
                       copies: DataFrame) -> DataFrame:
    """``key``, ``node`` and ``bound`` of the signatures that several different sets share.

    Ids that only have copies are left out: the first of them has the same signatures.
    """
    total = profiles.agg(F.sum("n_shingles")).first()[0] or 0
    packed = texts.where("doc_id is not null").mapInArrow(
        _signature_rows(bucket_bits(total)), "bucket int, low array<int>, bounds array<tinyint>, first long, "
        "steps array<tinyint>, far_steps array<long>")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _colliding, "key long, node long, bound tinyint")
    several = not profiles.groupBy("doc_id").count().where("count > 1").isEmpty()
    others = copies.select(F.col("doc_id").alias("node"))
    if several:
        # An id with a copy may also be the first with another text.
        others = others.join(firsts.select(F.col("first").alias("node")), "node", "left_anti")
    few = copies.count() <= BROADCAST_IDS
    own = met.join(F.broadcast(others) if few else others, "node", "left_anti")
    if several:
        own = own.groupBy("key", "node").agg(F.min("bound").alias("bound"))
    counted = own.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    return scratch.keep(counted.where("n > 1").drop("n"), "owned")


def _near_sizes(scratch: Scratch, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs whose sizes are near enough, so that signatures and shingles of the others are not sent."""
    sizes = profiles.where("n_shingles > 0").select("doc_id", "n_shingles").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("doc_id").alias(end), F.col("n_shingles").alias(f"size_{end}")), end)
    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * PERCENT
    return scratch.keep(pairs.where(near).select("a", "b").distinct(), "near_sizes")


def _promising(scratch: Scratch, pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs that share as many signatures as either bound asks for."""
    nodes = scratch.keep(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "paired")
    if nodes.count() <= BROADCAST_IDS:
        # So that signatures of the others are not sent.
        bags = bags.join(F.broadcast(nodes), "node", "left_semi")
    one = bags.select(F.col("node").alias("a"), F.col("keys").alias("keys_a"), F.col("bound").alias("bound_a"))
    two = bags.select(F.col("node").alias("b"), F.col("keys").alias("keys_b"), F.col("bound").alias("bound_b"))
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    both = pairs.join(one, "a").join(two, "b").where(shared >= F.greatest("bound_a", "bound_b"))
    return scratch.keep(both.select("a", "b"), "promising")


def _bounded(members: DataFrame, bags: DataFrame) -> DataFrame:
    """The members with as many open keys as their bound asks for.

    All keys that two similar sets share are open until the two are compared or connected.
    """
    enough = members.groupBy("node").agg(F.count("*").alias("n")).join(bags.select("node", "bound"), "node").where(
        F.col("n") >= F.col("bound")).select("node")
    return members.join(enough, "node", "left_semi")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for begin, end in _slices(texts):
            sets = shingle_sets(texts[begin:end])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[begin:end], sets.sizes)), pa.array(sets.hashes.view(np.int64))],
                ["node", "shingle"])


def _hopeful(scratch: Scratch, texts: DataFrame, profiles: DataFrame, members: DataFrame) -> DataFrame:
    """The members that can still be similar to another member.

    A shingle that no other member has is in no intersection; a set with too many of them
    is similar to none. Ids of several rows are left alone.
    """
    nodes = scratch.keep(members.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    few = nodes.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(nodes) if few else nodes, "doc_id").select("doc_id", "text")
    own = found.mapInArrow(_shingles, "node long, shingle long").groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("node").alias("doc_id")).where("n = 1").groupBy("doc_id").agg(
        F.count("*").alias("own"))
    sizes = profiles.join(nodes, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.max("n_shingles").alias("size"))
    hopeless = own.join(sizes, "doc_id").where("rows = 1").where(
        100 * (F.col("size") - F.col("own")) < PERCENT * F.col("size")).select(F.col("doc_id").alias("node"))
    return members.join(scratch.keep(hopeless, "hopeless"), "node", "left_anti")


def _linked_components(scratch: Scratch, texts: DataFrame, profiles: DataFrame) -> DataFrame:
    sets = profiles.where("n_shingles > 0 and doc_id is not null").select("doc_id", "print")
    firsts = scratch.keep(sets.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    copies = scratch.keep(sets.join(firsts, "print").where("doc_id <> first").select("doc_id", "first"), "copies")
    owned = _shared_signatures(scratch, texts, profiles, firsts, copies)
    # A bag holds no more keys than its text has signatures; one that holds fewer than its bound is similar to none.
    bags = scratch.keep(owned.groupBy("node").agg(
        F.collect_list("key").alias("keys"), F.min("bound").alias("bound")).where(F.size("keys") >= F.col("bound")), "bags")
    members = placed_members(scratch, bags.select(
        F.explode("keys").alias("key"), "node", F.size("keys").alias("fame")), ["key"])
    links = copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(scratch, texts, _promising(scratch, _near_sizes(scratch, pairs, profiles), bags))

    def hopeful(open_members: DataFrame) -> DataFrame:
        return _hopeful(scratch, texts, profiles, scratch.keep(_bounded(open_members, bags), "bounded"))

    def narrow(open_members: DataFrame) -> tuple[DataFrame, DataFrame]:
        nodes = scratch.keep(open_members.select(F.col("node").alias("doc_id")).distinct(), "nodes")
        sets = _listed(scratch, texts, nodes).select(F.col("doc_id").alias("node"), F.col("shingles").alias("elements"))
        return possible_pairs(scratch, sets, open_members, ["key"], PERCENT)

    return settle(scratch, members, ["key"], links, verify, hopeful, narrow)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Copies are joined by their fingerprint. The sets of a signature are compared with one of
    them; of those that this does not connect, pairs that may be similar by what they differ
    in from the middle of their group (see ``possible_pairs``). A comparison counts the shared
    signatures first and the shared shingles only where there are as many as similar sets
    must share.
    """
    texts = _as_bytes(docs, id_col, text_col)
    with arrow_batches(docs.sparkSession, BATCH_ROWS), Scratch(docs.sparkSession) as scratch:
        profiles = scratch.keep(
            texts.mapInArrow(_profiles, "doc_id long, n_shingles long, print binary"), "profiles")
        labels = _linked_components(scratch, texts, profiles)
        return materialize(with_components(profiles.withColumn("node", F.col("doc_id")), labels).select(
            "doc_id", "n_shingles", F.col("component").alias("component_id")), "components")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, one for each id.

    Rows with a NULL id stay as they are. All columns stay, whatever their names.
    """
    verdict = jaccard_components(docs, id_col, text_col).where("doc_id is not null")
    away = free_name(docs, "jaccard_dropped")
    dropped = verdict.where("doc_id <> component_id").select(F.col("doc_id").alias(away)).distinct()
    few = dropped.count() <= BROADCAST_IDS
    same = F.col(id_col).cast("long") == F.col(away)
    kept = docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")
    if verdict.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    known = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return known.unionByName(kept.where(F.col(id_col).isNull()))
