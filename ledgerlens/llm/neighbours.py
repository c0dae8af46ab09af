"""Approximate nearest neighbours by a forest of sorted hash strings.

Every vector has one string of ``BITS`` bits in each of ``TREES`` trees: on which side of
a random hyperplane through the middle of the data it lies, bit after bit. A tree is the
sorted array of these strings. A query descends each tree to its longest common prefix, by
bisection, and then all trees ascend together, one bit at a time, until the vectors that
share at least that prefix in some tree are numerous enough; all of them are candidates
(none is capped away), ranked by exact distance.

The index is dealt by vector into shards of bounded size, each with a forest of its own
over all its vectors; a shard meets the queries in blocks of bounded size, and each pair of
shard and block gives its best ``k``. Equal vectors are one entry with their ``k`` + 1
smallest ids, which is all that any query can return of them.

Only the middle of the data (means of the components over all vectors) and the hyperplanes
(from a seed) are fitted.

Defined results: vectors that are NULL, empty, zero, of another length than most, or hold NULL or non-finite
components take no part. Distances are Euclidean in double precision, ties go to smaller
ids. A repeated id is found once for each different vector. Fewer candidates than ``k``
are all returned. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.session import materialize

NEAREST = 10
TREES = 48
BITS = 24
# Rows of a shard, and of a block of queries, on average.
SHARD_ROWS = 4_096
BLOCK_ROWS = 8_192
# The ascent stops at the first level with so many candidates in a shard and this share of
# it. Nearly unordered vectors, like those of the given tables, need a large share.
CANDIDATES = 256
CANDIDATE_SHARE = 0.4
SEED = 41
RESULT = "query_id long, vec_id long, score double"


def usable(column: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def hyperplanes(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dimensions, TREES * BITS))


def hash_strings(vectors: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """One row for each tree: the bit strings as whole numbers, first bit highest."""
    sides = ((vectors - middle) @ hyperplanes(vectors.shape[1]) > 0).reshape(len(vectors), TREES, BITS)
    return (sides.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(
        axis=2, dtype=np.uint64).T


class Forest:
    """Sorted arrays of the hash strings of one shard."""

    def __init__(self, vectors: np.ndarray, middle: np.ndarray):
        self.vectors, self.middle = vectors, middle
        hashes = hash_strings(vectors, middle)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)
        self.wanted = max(CANDIDATES, int(CANDIDATE_SHARE * len(vectors)))

    def ranges(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings with the same first ``bits`` bits begin and end, by tree and query."""
        rest = np.uint64((1 << (BITS - bits)) - 1)
        low, high = hashes & ~rest, hashes | rest
        begin = np.stack([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low)])
        end = np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high)])
        return begin, end

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, the rows found when the common ascent has enough of them."""
        hashes = hash_strings(queries, self.middle)
        found: list[np.ndarray | None] = [None] * len(queries)
        waiting = np.arange(len(queries))
        for bits in range(BITS, -1, -1):
            begin, end = self.ranges(hashes[:, waiting], bits)
            # No more than the sum over the trees can be found, so few sets are formed in vain.
            ready = (end - begin).sum(axis=0) >= min(self.wanted, len(self.vectors))
            settled = np.zeros(len(waiting), bool)
            for i in np.flatnonzero(ready):
                met = np.zeros(len(self.vectors), bool)
                for t in range(TREES):
                    met[self.order[t, begin[t, i]:end[t, i]]] = True
                rows = np.flatnonzero(met)
                if len(rows) >= self.wanted or bits == 0:
                    found[waiting[i]], settled[i] = rows, True
            waiting = waiting[~settled]
            if not len(waiting):
                break
        for rows in found:
            yield np.arange(len(self.vectors)) if rows is None else rows


def _search(points: pd.DataFrame, queries: pd.DataFrame, middle: np.ndarray, k: int) -> pd.DataFrame:
    found: list[tuple[int, int, float]] = []
    if len(points) and len(queries):
        forest = Forest(np.stack(points["vector"].to_numpy()).astype(np.float64), middle)
        asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        ids = [np.asarray(x) for x in points["ids"]]
        for query, vector, rows in zip(queries["query_id"], asked, forest.candidates(asked)):
            distances = np.sqrt(((forest.vectors[rows] - vector) ** 2).sum(axis=1))
            near = rows[distances <= np.partition(distances, min(k, len(rows) - 1))[min(k, len(rows) - 1)]]
            best = [(float(np.sqrt(((forest.vectors[r] - vector) ** 2).sum())), int(i))
                    for r in near for i in ids[r] if i != query]
            found += [(int(query), i, d) for d, i in sorted(best)[:k]]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def nearest(embeddings: DataFrame, queries: DataFrame | None = None, k: int = NEAREST,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the distance.

    ``queries`` has the same two columns; by default they are the rows whose id is
    divisible by 100. A query never finds its own id.
    """
    def plain(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(
            usable(F.col("vector")) & F.col("vec_id").isNotNull())

    spark = embeddings.sparkSession
    everything = materialize(plain(embeddings), "vectors")
    sizes = everything.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(
        F.desc("rows"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions, total = sizes[0]["n"], sizes[0]["rows"]
    everything = everything.where(F.size("vector") == dimensions)
    asked = everything.where("vec_id % 100 = 0") if queries is None else plain(queries).where(
        F.size("vector") == dimensions)
    asked = asked.select(F.col("vec_id").alias("query_id"), "vector")
    middle = np.array(everything.agg(*[
        F.avg(F.col("vector")[i]).alias(f"m{i}") for i in range(dimensions)]).first(), np.float64)

    smallest = Window.partitionBy("vector").orderBy("vec_id")
    entries = materialize(everything.withColumn("place", F.dense_rank().over(smallest)).where(
        F.col("place") <= k + 1).groupBy("vector").agg(F.collect_set("vec_id").alias("ids")), "entries")
    shards = -(-total // SHARD_ROWS)
    blocks = -(-asked.count() // BLOCK_ROWS)
    one = entries.select(
        "vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"))
    two = asked.select(
        "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def run(points: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _search(points, block, middle, k)

    found = one.groupBy("shard", "block").cogroup(two.groupBy("shard", "block")).applyInPandas(run, RESULT)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
