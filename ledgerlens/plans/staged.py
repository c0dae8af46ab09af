"""What a boosted model was worth after each of its rounds.

The trees of a fitted model are read back as a table of nodes. One pass over the rows gives each
of them its margin after every round; the measure of all rounds then comes from one grouping.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators.ranking import running_sums
from ledgerlens.session import Scratch, scratch_path
from ledgerlens.shipping import ship_code

# The probability of a margin m is 1 / (1 + exp(-2 m)); log losses are cut at this probability.
MARGIN_FACTOR = 2.0
LEAST_PROBABILITY = 1e-15
# Rows whose margins are computed together.
MARGIN_ROWS = 4096


def node_table(model: Model) -> DataFrame:
    """Rows (tree, weight, node, feature, threshold, below, above, prediction, gain, n) of a tree ensemble.

    ``below`` is the node of the rows up to the threshold, ``above`` that of the others; leaves
    have -1. The model is written to the shared folder and its node table read.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "model")
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("below"), F.col("rightChild").alias("above"), "prediction", "gain",
        F.col("rawCount").alias("n"),
    ).join(weights, "tree")


def split_counts(model: Model, features: Sequence[str]) -> DataFrame:
    """Rows (feature, importance, splits): how often each feature splits a node, and its share of all splits."""
    names = F.array(*[F.lit(name) for name in features])
    used = node_table(model).where("below >= 0").groupBy("feature").agg(F.count("*").alias("splits"))
    total = used.agg(F.sum("splits").alias("total"))
    # One row.
    return used.join(F.broadcast(total)).select(
        F.get(names, F.col("feature")).alias("feature"), (F.col("splits") / F.col("total")).alias("importance"),
        "splits")


@dataclass(frozen=True)
class Trees:
    """The nodes of all trees as arrays by tree and node, small enough to go to every task."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, model: Model) -> Trees:
        rows = node_table(model).collect()
        shape = (max(r.tree for r in rows) + 1, max(r.node for r in rows) + 1)
        feature, below, above = (np.full(shape, -1, np.int32) for _ in range(3))
        threshold, value = np.zeros(shape), np.zeros(shape)
        for r in rows:
            at = r.tree, r.node
            feature[at], below[at], above[at] = r.feature, r.below, r.above
            threshold[at] = r.threshold or 0.0
            value[at] = r.prediction * r.weight
        return cls(feature, threshold, below, above, value)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees so far, one row for each row of ``x`` and one column for each tree."""
        tree = np.arange(len(self.feature))
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(tree)), np.int32)
        while True:
            below = self.below[tree, node]
            inner = below >= 0
            if not inner.any():
                return np.cumsum(self.value[tree, node], axis=1)
            left = x[row, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(inner, np.where(left, below, self.above[tree, node]), node)


def staged_margins(model: Model, rows: DataFrame, rounds: Sequence[int] | None = None) -> DataFrame:
    """``label`` and ``margins`` of every row (label, features) after the given rounds, by default after each."""
    ship_code(rows.sparkSession)
    trees = Trees.of(model)
    kept = np.array(rounds) - 1 if rounds is not None else slice(None)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, MARGIN_ROWS):
                part = batch.slice(begin, MARGIN_ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                sums = trees.margins(x)[:, kept]
                flat = pa.array(np.ascontiguousarray(sums).ravel())
                places = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(places, flat)], ["label", "margins"])

    return rows.select("label", vector_to_array("features").alias("x")).mapInArrow(
        margins, "label double, margins array<double>")


def ranked_scores(scratch: Scratch, scores: DataFrame, by: Sequence[str], score: str = "score",
                  label: str = "label") -> DataFrame:
    """Each score of a group once: its ones and zeros, those below it and those of the group.

    Equal scores of a group are one row; what is below each comes from running sums, so a group of any
    size is spread over the tasks.
    """
    ones = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("ones")
    zeros = F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("zeros")
    counted = scores.groupBy(*by, score).agg(ones, zeros)
    return running_sums(scratch, counted, by, [score], ["ones", "zeros"], distinct=True)


def ranked_areas(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``auc``: the exact area under the curve of each group of ranked scores, ties counting half.

    A group without both classes has NULL.
    """
    # Whole numbers: twice the rightly ordered pairs.
    twice = F.sum(F.expr("cast(ones as decimal(19,0)) * cast(2 * before_zeros + zeros as decimal(19,0))"))
    pairs = F.max(F.expr("2 * cast(all_ones as decimal(18,0)) * cast(all_zeros as decimal(18,0))"))
    return ranked.groupBy(*by).agg(
        F.try_divide(twice.cast("double"), F.nullif(pairs.cast("double"), F.lit(0.0))).alias("auc"))


def grouped_areas(scratch: Scratch, scores: DataFrame, by: Sequence[str], score: str = "score",
                  label: str = "label") -> DataFrame:
    """``by``, ``auc``: the exact area under the curve of each group of scores."""
    return ranked_areas(ranked_scores(scratch, scores, by, score, label), by)


def areas_by_round(model: Model, rows: DataFrame, rounds: Sequence[int] | None = None) -> list[float]:
    """The exact area under the curve of ``rows`` (label, features) after the given rounds, by default after each."""
    long = staged_margins(model, rows, rounds).select("label", F.posexplode("margins").alias("round", "score"))
    with Scratch(rows.sparkSession) as scratch:
        found = grouped_areas(scratch, long, ["round"]).collect()
    return [r.auc for r in sorted(found, key=lambda r: r["round"])]


def losses_at(model: Model, rows: DataFrame, rounds: Sequence[int]) -> list[float]:
    """The mean log loss of ``rows`` (label, features) after each of ``rounds``."""
    staged = staged_margins(model, rows, rounds)
    sign = F.when(F.col("label") == 1, MARGIN_FACTOR).otherwise(-MARGIN_FACTOR)
    right = [1 / (1 + F.exp(-sign * F.col("margins")[i])) for i in range(len(rounds))]
    means = staged.agg(*[
        (-F.avg(F.log(F.greatest(p, F.lit(LEAST_PROBABILITY))))).alias(f"loss_{i}") for i, p in enumerate(right)])
    return list(means.first())


def best_round(values: Sequence[float], patience: int) -> tuple[int, bool]:
    """The first round of the highest value so far, when ``patience`` further ones brought no higher one.

    Rounds count from 1. The second value tells whether patience ended; otherwise the values did.
    """
    best = 0
    for at, value in enumerate(values):
        if value > values[best]:
            best = at
        elif at - best >= patience:
            return best + 1, True
    return best + 1, False
