"""Train, tune, evaluate and apply classifiers on the feature matrix.

Boosted trees are Spark's own. Parameters are carried over where Spark has a
counterpart, so scores are alike in kind, not equal in value, to those of other
boosted-tree libraries.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from hashlib import sha256
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.ranking import KeyRanks
from ledgerlens.operators.sampling import (
    LABEL,
    balance_classes,
    cut_ids,
    first_rows,
    labelled,
    positional_split,
    stratified_folds,
)
from ledgerlens.plans import network
from ledgerlens.plans.network import Network
from ledgerlens.plans.staged import areas_by_round, best_round, losses_at
from ledgerlens.session import materialize, scratch_dir, scratch_path

# Class sizes of the evaluation sweep, the tuning grid by field of
# BoostParams, the sample of the tuning, the hidden layers, the network's epochs, batch and
# step, and the patience.
SWEEP_CAPS = (50, 250, 900, 1300, 1600)
GRID = {
    "step_size": [0.05, 0.15, 0.25, 0.5],
    "max_depth": [2, 3, 4, 6, 8],
    "child_weight": [1, 3, 5, 7],
    "split_loss": [0.0, 0.1, 0.2, 0.3, 0.4],
    "rounds": [20, 50, 100, 250, 500, 800, 1000],
    "column_share": [0.3, 0.4, 0.5, 0.7],
}
GRID_ONES = 1000
GRID_FOLDS = 3
HIDDEN_LAYERS = (12, 128, 64, 64, 32, 32, 16, 8)
NETWORK_EPOCHS = 50
NETWORK_BATCH = 128
NETWORK_STEP = 0.01
PATIENCE = 60
# Rounds of the first trial of a fit; later trials have four times as many.
FIRST_ROUNDS = 80
# Rounds whose areas are found together.
LOOKED_AT_ROUNDS = 160
SEED = 1


@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree parameters (the defaults are fixed values of the tuned model).

    ``split_loss`` and ``child_weight`` are totals over the rows of a node.
    Spark wants the gain per row and a row count: the loss is divided by the
    number of training rows, and a row weighs at most a quarter.
    """

    step_size: float = 0.05
    max_depth: int = 2
    split_loss: float = 0.4
    child_weight: float = 3
    column_share: float = 0.3
    rounds: int = 1000
    patience: int = PATIENCE

    def tuned(self, values: Mapping[str, object]) -> BoostParams:
        """With the values of a grid point; the number of rounds stays."""
        return replace(self, **{k: v for k, v in values.items() if k != "rounds"})

    def spark_values(self, rows: int) -> dict[str, object]:
        """The parameters under Spark's names and in its units, for a training set of ``rows``."""
        return {
            "stepSize": float(self.step_size),
            "maxDepth": int(self.max_depth),
            "minInfoGain": float(self.split_loss) / max(rows, 1),
            "minInstancesPerNode": max(1, int(self.child_weight * 4)),
            "featureSubsetStrategy": str(self.column_share),
            "maxIter": int(self.rounds),
        }

    def classifier(self, rows: int) -> GBTClassifier:
        return GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, **self.spark_values(rows))


# A library's defaults: no penalty of splits, all columns.
PLAIN_BOOST = BoostParams(step_size=0.3, max_depth=5, split_loss=0.0, child_weight=1,
                          column_share=1.0, rounds=100)


def to_vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Assemble the features; rename the label, if any, as a double."""
    kept = ["id"]
    if LABEL in df.columns:
        df = df.withColumn("label", F.col(LABEL).cast("double"))
        kept.append("label")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return assembler.transform(df).select(*kept, "features")


def train_boosted(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    params: BoostParams = BoostParams(),
    balance_factor: float = 1.0,
) -> Model:
    """Boosted trees on a balanced training set, as many as a balanced validation set asks for.

    Rounds go on until ``patience`` of them bring no higher area under the curve of the validation
    set; the trees up to the highest one are kept. A longer fit begins with the same trees, so a
    short one is tried first, and of a longer one only the further rounds are looked at, until patience ends.
    """
    scratch_dir(train.sparkSession)  # the trainer checkpoints its own state there
    flagged = balance_classes(
        train.withColumn("held_out", F.lit(False)).unionByName(validation.withColumn("held_out", F.lit(True))),
        balance_factor=balance_factor, by=["held_out"])
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(flagged)
    rows = materialize(
        vectors.select("id", F.col(LABEL).cast("double").alias("label"), "held_out", "features"),
        "training",
    )
    fit_rows, check_rows = (rows.where(F.col("held_out") == held).drop("held_out") for held in (False, True))
    n = fit_rows.count()
    rounds = min(max(FIRST_ROUNDS, params.patience + 1), params.rounds)
    areas: list[float] = []
    best, ended = best_round(areas, params.patience)
    while True:
        model = replace(params, rounds=rounds).classifier(n).fit(fit_rows)
        while len(areas) < rounds and not ended:
            further = range(len(areas) + 1, min(len(areas) + LOOKED_AT_ROUNDS, rounds) + 1)
            found = areas_by_round(model, check_rows, further)
            if not found:  # no row to look at
                break
            areas += found
            best, ended = best_round(areas, params.patience)
        if ended or rounds >= params.rounds:
            break
        rounds = min(rounds * 4, params.rounds)
    return model if best == rounds else replace(params, rounds=best).classifier(n).fit(fit_rows)


def score(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (id, [label], probabilidad, clase); the class rounds halves to even."""
    scored = model.transform(to_vectors(df, features))
    label = ["label"] if "label" in scored.columns else []
    probability = vector_to_array("probability")[1]
    return scored.select("id", *label, probability.alias("probabilidad")).withColumn(
        "clase", F.bround("probabilidad").cast("int")
    )


def area_under_roc(scores: DataFrame) -> float:
    """Exact area: every distinct score is a threshold."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="probabilidad", labelCol="label", metricName="areaUnderROC", numBins=0
    )
    return evaluator.evaluate(scores.where(F.col("label").isNotNull()))


def cap_sweep(
    model: Model, test: DataFrame, features: Sequence[str], caps: Iterable[int] = SWEEP_CAPS
) -> DataFrame:
    """One row per cap: errors on the first ``cap`` rows of each class of the test set.

    The ids that end the caps are found together, and one pass over the rows of the largest cap
    counts for all of them.
    """
    caps = sorted(caps)
    rows = labelled(test)
    cuts = cut_ids(KeyRanks(rows, "id", [LABEL]), {(0,): caps, (1,): caps})
    within = {cap: first_rows([LABEL], {at: cut for at, cut in cuts.items() if at[1] == cap}) for cap in caps}
    scored = score(model, rows.where(within[caps[-1]]), features).withColumn(LABEL, F.col("label"))

    sums = scored.agg(*[
        F.struct(
            F.lit(cap).alias("cap"),
            F.count_if(inside & (F.col("clase") == 1)).alias("predicted_ones"),
            F.count_if(inside & (F.col("label") == 1)).alias("expected_ones"),
            F.count_if(inside & (F.col("clase") != F.col("label"))).alias("wrong"),
            F.count_if(inside).alias("n"),
        ).alias(f"cap_{cap}")
        for cap, inside in within.items()
    ])
    table = sums.select(F.inline(F.array(*[f"cap_{cap}" for cap in caps]))).where("n > 0")
    return table.withColumn("error", F.col("wrong") / F.col("n"))


def grid_search(
    matrix: DataFrame,
    features: Sequence[str],
    grid: Mapping[str, Sequence] = GRID,
    base: BoostParams = BoostParams(),
    folds: int = GRID_FOLDS,
    max_ones: int | None = None,
    parallelism: int = 4,
    store: str | None = None,
) -> DataFrame:
    """Mean log loss of every grid point over stratified folds, best first.

    All labelled rows are dealt to the folds, or the first ``max_ones`` of each class. The grid names fields of ``BoostParams``; it is off unless called, as it is large. Points that
    differ only in their rounds come from one fit of the most rounds, whose losses are
    taken after the rounds of each. The losses of a fit are written to ``store`` when it
    is done, and a later call with the same rows and parameters goes on from there.
    """
    spark = matrix.sparkSession
    store = store or scratch_path(spark, "grid")
    seen = labelled(matrix) if max_ones is None else balance_classes(matrix, max_ones=max_ones)
    sample = stratified_folds(seen, folds)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(sample)
    rows = materialize(
        vectors.select("id", F.col(LABEL).cast("double").alias("label"), "fold", "features"), "folds"
    )
    n, print_ = rows.agg(F.count("*"), F.sum(F.xxhash64(
        "id", "label", "fold", vector_to_array("features")).cast("decimal(38,0)"))).first()
    rounds = sorted(set(grid.get("rounds", [base.rounds])))
    axes = {name: values for name, values in grid.items() if name != "rounds"}
    shapes = [dict(zip(axes, values)) for values in product(*axes.values())]

    def key(shape: Mapping[str, object]) -> str:
        params = replace(base, **shape, rounds=rounds[-1])
        return sha256(f"{list(features)} {params} {rounds} {folds} {n} {print_}".encode()).hexdigest()

    def fit(shape: Mapping[str, object], fold: int) -> None:
        learner = replace(base, **shape, rounds=rounds[-1]).classifier(n)
        model = learner.fit(rows.where(F.col("fold") != fold))
        losses = losses_at(model, rows.where(F.col("fold") == fold), rounds)
        found = [(r, float(loss)) for r, loss in zip(rounds, losses)]
        spark.createDataFrame(found, "rounds int, log_loss double").coalesce(1).write.mode("overwrite").parquet(
            f"{store}/point={key(shape)}/fold={fold}")

    def done() -> DataFrame:
        return spark.read.schema("rounds int, log_loss double, point string, fold int").parquet(store)

    scratch_dir(spark)  # the trainer checkpoints its own state there
    try:
        known = {(r.point, r.fold) for r in done().select("point", "fold").distinct().collect()}
    except AnalysisException:  # nothing is stored yet
        known = set()
    missing = [(shape, fold) for shape in shapes for fold in range(folds) if (key(shape), fold) not in known]
    with ThreadPoolExecutor(parallelism) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(fit), *point) for point in missing]:
            job.result()
    points = spark.createDataFrame(
        [(key(shape), {name: str(v) for name, v in shape.items()}) for shape in shapes],
        "point string, shape map<string,string>")
    params = F.col("shape")
    if "rounds" in grid:
        params = F.map_concat("shape", F.create_map(F.lit("rounds"), F.col("rounds").cast("string")))
    # A row for each fit of the grid; its mean over the folds is a row for each point.
    table = done().join(points, "point").groupBy("point", "rounds").agg(
        F.first("shape").alias("shape"), F.avg("log_loss").alias("log_loss")).select(params.alias("params"), "log_loss")
    return table.orderBy("log_loss", F.col("params").cast("string"))


def best_point(found: DataFrame, grid: Mapping[str, Sequence] = GRID) -> dict[str, object]:
    """The grid point of the lowest loss, with the values of the grid."""
    params = found.orderBy("log_loss", F.col("params").cast("string")).first().params
    return {name: next(v for v in grid[name] if str(v) == text) for name, text in params.items()}


def train_network(
    sample: DataFrame, features: Sequence[str], epochs: int = NETWORK_EPOCHS, batch: int = NETWORK_BATCH,
    step: float = NETWORK_STEP, momentum: float = 0.0, seed: int = SEED,
) -> Network:
    """Feed-forward network with the given hidden layers of rectified units and one sigmoid output.

    Plain descent on the cross entropy, a mini-batch at a time.
    """
    vectors = to_vectors(sample, features).where("label is not null")
    rows = materialize(vectors.select("id", "label", vector_to_array("features").alias("x")), "network")
    return network.fit(rows, [len(features), *HIDDEN_LAYERS, 1], epochs, batch, step, momentum, seed)


def train_and_evaluate(
    matrix: DataFrame, features: Sequence[str], params: BoostParams = BoostParams()
) -> tuple[Model, DataFrame]:
    """Split by position, train on the first part, sweep the caps on the rest."""
    train, test = positional_split(matrix)
    model = train_boosted(train, test, features, params)
    return model, cap_sweep(model, test, features)
