"""A trained model with all that scoring needs: columns, scaler and where it came from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators.scaling import Scaler
from ledgerlens.plans.training import score


@dataclass(frozen=True)
class Bundle:
    """``features`` are the model's columns in its order; the scaler knows all columns of the training matrix."""

    model: GBTClassificationModel
    features: Sequence[str]
    scaler: Scaler
    fingerprint: str = ""

    def save(self, spark: SparkSession, path: str) -> None:
        """Model, scaler and columns in folders of ``path``; the columns come last and make it complete."""
        self.model.write().overwrite().save(f"{path}/model")
        save_scaler(spark, self.scaler, f"{path}/scaler")
        rows = [(i, name, self.fingerprint) for i, name in enumerate(self.features)]
        spark.createDataFrame(rows, "place int, feature string, fingerprint string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        model = GBTClassificationModel.load(f"{path}/model")
        return cls(model, [r.feature for r in rows], load_scaler(spark, f"{path}/scaler"), rows[0].fingerprint)

    def score(self, matrix: DataFrame) -> DataFrame:
        """Scores of a scaled matrix; it must have the columns of the model, others do not matter."""
        missing = [c for c in self.features if c not in matrix.columns]
        if missing:
            raise ValueError(f"the matrix lacks columns of the model: {', '.join(missing)}")
        return score(self.model, matrix, self.features)


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    rows = [(i, c, float(scaler.means[c] or 0.0), float(scaler.deviations[c] or 0.0)) for i, c in enumerate(scaler.means)]
    spark.createDataFrame(rows, "place int, feature string, mean double, deviation double").coalesce(1).write.mode(
        "overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = spark.read.parquet(path).orderBy(F.col("place")).collect()
    return Scaler({r.feature: r.mean for r in rows}, {r.feature: r.deviation for r in rows})
