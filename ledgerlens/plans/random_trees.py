"""Extremely randomized trees: random thresholds, large nodes split together, small ones grown by one task each.

Every tree sees every row. A node looks at some features that vary in it, each with one threshold drawn
between the feature's smallest and largest value there, and takes the one that lowers the Gini
impurity most; trees grow until their leaves are pure or do not vary. Nodes of more rows than a task
should hold are split level by level, those of all trees together: one pass over the rows finds the spans, one counts
both sides, and only these sums leave the tasks. The rows of the other nodes are then sent once for each tree, packed
by node, and a task grows all that is below a node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import md5
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.draws import DRAW_DIGITS, drawn
from ledgerlens.plans.training import SEED, to_vectors
from ledgerlens.session import Scratch, materialize
from ledgerlens.shipping import ship_code

TREES = 100
# Values of the rows that one task grows a node on, in bytes.
NODE_BYTES = 32 << 20
# Rows that are packed together, and trees that share the rows where not even a root is large.
PACKED_ROWS = 50_000
TREES_TOGETHER = 5
CODEC = "zstd"
GAINS = "tree int, feature int, gain double"


def features_looked_at(width: int) -> int:
    """The whole square root of the number of features, one at least."""
    return max(1, isqrt(width))


def _weighted_gini(n, ones):
    """Rows times impurity."""
    return np.divide(2.0 * ones * (n - ones), n, out=np.zeros(np.shape(n)), where=np.asarray(n) > 0)


def _drawn_order(features: np.ndarray, tree: int, path: str, seed: int) -> list[int]:
    """The features by the number drawn for each; digits of one length are in the order of their numbers."""
    node = md5(f"{seed}:{tree}:{path}:".encode())
    turns = []
    for i in features.tolist():
        turn = node.copy()
        turn.update(b"%d:feature" % i)
        turns.append((turn.hexdigest()[:DRAW_DIGITS], i))
    return [i for _, i in sorted(turns)]


def _candidates(
    lo: np.ndarray, hi: np.ndarray, tree: int, path: str, looked_at: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Features and thresholds that a node looks at, in the order drawn."""
    chosen = np.array(_drawn_order(np.flatnonzero(lo < hi), tree, path, seed)[:looked_at], np.int64)
    u = np.array([drawn(seed, tree, path, i, "threshold") for i in chosen.tolist()])
    least, most = lo[chosen], hi[chosen]
    between = least + u * (most - least)
    # Rounding must not leave the upper side empty.
    return chosen, np.where(between < most, between, least)


def _gains(n: int, ones: float, n_low: np.ndarray, ones_low: np.ndarray) -> np.ndarray:
    whole = _weighted_gini(np.float64(n), np.float64(ones))
    return whole - _weighted_gini(n_low, ones_low) - _weighted_gini(n - n_low, ones - ones_low)


def grow_alone(x: np.ndarray, y: np.ndarray, tree: int, path: str, looked_at: int, seed: int) -> np.ndarray:
    """The summed gain of each feature in all nodes from the node ``path`` of a tree down."""
    gains = np.zeros(x.shape[1])
    open_ = [(x, y, path)]
    while open_:
        x, y, path = open_.pop()
        n, ones = len(y), y.sum()
        if not 0 < ones < n:
            continue
        chosen, thresholds = _candidates(x.min(axis=0), x.max(axis=0), tree, path, looked_at, seed)
        if not len(chosen):
            continue
        low = x[:, chosen] <= thresholds
        gain = _gains(n, ones, low.sum(axis=0).astype(float), y @ low)
        best = int(np.argmax(gain))  # the first drawn on a tie
        gains[chosen[best]] += gain[best]
        side = low[:, best]
        open_ += [(x[side], y[side], path + "0"), (x[~side], y[~side], path + "1")]
    return gains


@dataclass
class Node:
    """A node; ``number`` is its place among those that are looked at now, -1 in others.

    ``path`` says for each level above whether the node is on the lower (0) or upper side (1).
    """

    tree: int
    path: str
    feature: int = -1
    threshold: float = 0.0
    below: Node | None = None
    above: Node | None = None
    number: int = -1


def _places(roots: Sequence[Node], x: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
    """The numbered nodes that rows of ``x`` fall into, with the places of these rows."""
    open_ = [(root, np.arange(len(x))) for root in roots]
    while open_:
        node, at = open_.pop()
        if not len(at):
            continue
        if node.feature >= 0:
            low = x[at, node.feature] <= node.threshold
            open_ += [(node.below, at[low]), (node.above, at[~low])]
        elif node.number >= 0:
            yield node, at


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column(0).to_numpy(zero_copy_only=False)
    return y, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)


def _listed(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    places = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(values).ravel()))


def _spans(rows: DataFrame, roots: Sequence[Node], numbered: int, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The least and the largest value of each feature in the numbered nodes; a row of sums for each task and node."""
    shared = rows.sparkSession.sparkContext.broadcast(roots)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full((numbered, width), np.inf), np.full((numbered, width), -np.inf)
        for batch in batches:
            _, x = _values(batch)
            for node, at in _places(shared.value, x):
                some = x[at]
                np.minimum(lo[node.number], some.min(axis=0), out=lo[node.number])
                np.maximum(hi[node.number], some.max(axis=0), out=hi[node.number])
        seen = np.flatnonzero(lo[:, 0] <= hi[:, 0])
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), _listed(lo[seen]), _listed(hi[seen])], ["number", "lo", "hi"])

    def each(kind: str, column: str):
        return F.expr(f"array({', '.join(f'{kind}(get({column}, {i}))' for i in range(width))})").alias(column)

    parts = rows.select("label", "x").mapInArrow(per_task, "number bigint, lo array<double>, hi array<double>")
    found = parts.groupBy("number").agg(each("min", "lo"), each("max", "hi")).collect()
    shared.destroy()
    return {r.number: (np.array(r.lo), np.array(r.hi)) for r in found}


def _counts(rows: DataFrame, roots: Sequence[Node], looked: Sequence[tuple[np.ndarray, np.ndarray]],
            looked_at: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and ones on the lower side of each candidate of the numbered nodes."""
    shared = rows.sparkSession.sparkContext.broadcast((roots, looked))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, looked = shared.value
        n_low, ones_low = np.zeros((len(looked), looked_at)), np.zeros((len(looked), looked_at))
        for batch in batches:
            y, x = _values(batch)
            for node, at in _places(roots, x):
                chosen, thresholds = looked[node.number]
                low = x[np.ix_(at, chosen)] <= thresholds
                n_low[node.number, :len(chosen)] += low.sum(axis=0)
                ones_low[node.number, :len(chosen)] += y[at] @ low
        seen = np.flatnonzero(n_low.any(axis=1))
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), _listed(n_low[seen]), _listed(ones_low[seen])], ["number", "n_low", "ones_low"])

    def each(column: str):
        return F.expr(f"array({', '.join(f'sum(get({column}, {i}))' for i in range(looked_at))})").alias(column)

    parts = rows.select("label", "x").mapInArrow(
        per_task, "number bigint, n_low array<double>, ones_low array<double>")
    found = parts.groupBy("number").agg(each("n_low"), each("ones_low")).collect()
    shared.destroy()
    return {r.number: (np.array(r.n_low), np.array(r.ones_low)) for r in found}


@dataclass
class Grown:
    """Trees as far as their large nodes go: gains (tree, feature, gain), and the smaller nodes still to be grown."""

    roots: list[Node]
    gains: list[tuple[int, int, float]] = field(default_factory=list)
    small: list[Node] = field(default_factory=list)


def grow_large(rows: DataFrame, n: int, ones: float, width: int, trees: int, seed: int, limit: int) -> Grown:
    """Split all nodes of more than ``limit`` rows of ``rows`` (label 0 or 1, x), level by level.

    What meets on the driver is a few numbers for each feature of these nodes, not more of them than rows over ``limit`` in a tree.
    """
    grown = Grown([Node(tree, "") for tree in range(trees)])
    level = [(root, n, ones) for root in grown.roots]
    while True:
        mixed = [(node, n, ones) for node, n, ones in level if 0 < ones < n]
        grown.small += [node for node, n, _ in mixed if n <= limit]
        large = [(node, n, ones) for node, n, ones in mixed if n > limit]
        if not large:
            return grown
        for number, (node, _, _) in enumerate(large):
            node.number = number
        looked_at = features_looked_at(width)
        spans = _spans(rows, grown.roots, len(large), width)
        looked = [_candidates(*spans[node.number], node.tree, node.path, looked_at, seed) for node, _, _ in large]
        counts = _counts(rows, grown.roots, looked, looked_at)
        level = []
        for (node, n, ones), (chosen, thresholds) in zip(large, looked):
            number, node.number = node.number, -1
            if not len(chosen):  # no feature varies
                continue
            n_low, ones_low = (sums[:len(chosen)] for sums in counts[number])
            gain = _gains(n, ones, n_low, ones_low)
            best = int(np.argmax(gain))  # the first drawn on a tie
            node.feature, node.threshold = int(chosen[best]), float(thresholds[best])
            node.below, node.above = Node(node.tree, node.path + "0"), Node(node.tree, node.path + "1")
            grown.gains.append((node.tree, node.feature, float(gain[best])))
            level += [(node.below, int(n_low[best]), float(ones_low[best])),
                      (node.above, n - int(n_low[best]), float(ones - ones_low[best]))]


def _pack(y: np.ndarray, x: np.ndarray) -> bytes:
    """Labels and values, column by column, as few bytes as that takes."""
    return pa.compress(np.concatenate([y[None], x.T]).tobytes(), codec=CODEC, asbytes=True)


def _unpack(n: int, width: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n * (width + 1) * 8, codec=CODEC, asbytes=True)).reshape(width + 1, n)


def grow_small(rows: DataFrame, grown: Grown, width: int, seed: int) -> DataFrame:
    """Gains (tree, feature, gain) of all that is below the smaller nodes; a task has the rows of a node, packed."""
    small, roots = grown.small, grown.roots
    if all(not node.path for node in small):
        # The whole table is one node: some trees share its rows.
        groups = [(small[i:i + TREES_TOGETHER], "") for i in range(0, len(small), TREES_TOGETHER)]
        roots = [node for (node, *_), _ in groups]
    else:
        groups = [([node], node.path) for node in small]
    for number, ((node, *_), _) in enumerate(groups):
        node.number = number
    grown_by = [([node.tree for node in nodes], path) for nodes, path in groups]
    context = rows.sparkSession.sparkContext
    # The last use of both comes after this function has ended.
    shared, shared_groups = context.broadcast(roots), context.broadcast(grown_by)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, x in _chunks(batches):
            for root in shared.value:
                parts = [(node.number, len(at), _pack(y[at], x[at])) for node, at in _places([root], x)]
                if parts:
                    numbers, sizes, values = zip(*parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())],
                        ["number", "n", "packed"])

    def below(table: pa.Table) -> pa.Table:
        found = []
        parts = [_unpack(n, width, some) for n, some in zip(table["n"].to_pylist(), table["packed"].to_pylist())]
        values = np.concatenate(parts, axis=1)
        y, x = values[0], np.ascontiguousarray(values[1:].T)
        del parts, values
        trees, path = shared_groups.value[table["number"][0].as_py()]
        for tree in trees:
            gains = grow_alone(x, y, tree, path, features_looked_at(width), seed)
            found += [(tree, int(i), float(gains[i])) for i in np.flatnonzero(gains)]
        numbers, features, gains = zip(*found) if found else ((), (), ())
        return pa.table({"tree": pa.array(numbers, pa.int32()), "feature": pa.array(features, pa.int32()),
                         "gain": pa.array(gains, pa.float64())})

    sent = rows.select("label", "x").mapInArrow(packed, "number bigint, n bigint, packed binary")
    # As many tasks as nodes, since packed rows say little about the work on them.
    return sent.repartition(max(1, len(groups)), "number").groupBy("number").applyInArrow(below, GAINS)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and values of some batches together, so that few parts of a node are packed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_values(batch))
        if sum(len(y) for y, _ in held) >= PACKED_ROWS:
            yield tuple(np.concatenate(column) for column in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(column) for column in zip(*held))


def random_tree_importance(sample: DataFrame, features: Sequence[str], trees: int = TREES, seed: int = SEED,
                           node_bytes: int = NODE_BYTES) -> DataFrame:
    """Rows (feature, importance): the share of each feature in the gain of a tree, averaged over the trees."""
    spark = sample.sparkSession
    ship_code(spark)
    vectors = to_vectors(sample, features).where("label is not null")
    names = F.array(*[F.lit(name) for name in features])
    width = len(features)
    with Scratch(spark) as scratch:
        rows = scratch.keep(vectors.select("id", "label", vector_to_array("features").alias("x")), "rows")
        n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        grown = grow_large(rows, n, ones, width, trees, seed, node_bytes // (8 * (width + 1)))
        large = spark.createDataFrame(grown.gains, GAINS)
        splits = scratch.keep(large.unionByName(grow_small(rows, grown, width, seed)), "splits")
        gains = splits.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        totals = gains.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
        shares = gains.join(totals, "tree")
        grown_trees = F.broadcast(totals.agg(F.count("*").alias("grown")))  # one row
        mean = shares.groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("sum")).join(grown_trees).select(
            F.get(names, F.col("feature")).alias("feature"), (F.col("sum") / F.col("grown")).alias("importance"))
        every = spark.createDataFrame([(f,) for f in features], "feature string")
        return materialize(every.join(mean, "feature", "left").na.fill(0.0, ["importance"]), "importance")
