"""How much each feature matters: tree importances and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.ranking import shuffled_positions
from ledgerlens.plans.network import Network
from ledgerlens.plans.training import SEED, to_vectors
from ledgerlens.session import materialize

TOP_IMPORTANCES = 20
STUDY_ONES = 200


def _importances(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_importances(importances: DataFrame, k: int = TOP_IMPORTANCES) -> DataFrame:
    """The ``k`` most important features, ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def boosted_importance(model: Model, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Gain importance in a fitted boosted model."""
    return _importances(model, sample, features)


def permutation_importance(
    model: Model,
    sample: DataFrame,
    features: Sequence[str],
    repeats: int = 5,
    seed: int = SEED,
) -> DataFrame:
    """Mean loss of accuracy when one feature's values are shuffled between rows.

    Each repeat pairs every row with the row at the same place of another random
    order by one join, then scores all features together: a network where the pair is, another model after a
    row for each feature is made.
    """
    vectors = to_vectors(sample.where(F.col("var_rpta").isNotNull()), features)
    rows = materialize(
        vectors.select("id", "label", vector_to_array("features").alias("x")), "permutation"
    )
    n = rows.count()

    def accuracy(df: DataFrame, *by: str) -> DataFrame:
        right = (F.col("prediction") == F.col("label")).cast("double")
        scored = model.transform(df.withColumn("features", array_to_vector("x")))
        return scored.groupBy(*by).agg(F.avg(right).alias("accuracy"))

    def swapped(paired: DataFrame) -> DataFrame:
        """Accuracy of each feature ``j`` taken from the other row."""
        if isinstance(model, Network):
            counts = model.right_when_swapped(paired).groupBy("j").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
            return counts.select("j", (F.col("right") / F.col("n")).alias("accuracy"))
        each = paired.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        spoiled = F.expr("transform(x, (v, i) -> if(i = j, other[i], v))")
        return accuracy(each.select("label", "j", spoiled.alias("x")), "j")

    base = accuracy(rows).first().accuracy
    scores = []
    for repeat in range(repeats):
        mine = shuffled_positions(rows, "id", seed + 2 * repeat, n)
        other = shuffled_positions(rows, "id", seed + 2 * repeat + 1, n)
        paired = mine.join(
            other.select("position", F.col("x").alias("other")), "position"
        )
        scores.append(swapped(paired))
    scored = _union(scores)
    names = F.array(*[F.lit(name) for name in features])
    return scored.groupBy("j").agg(
        (F.lit(base) - F.avg("accuracy")).alias("importance"),
        F.stddev_pop("accuracy").alias("deviation"),
    ).select(names[F.col("j")].alias("feature"), "importance", "deviation")


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
