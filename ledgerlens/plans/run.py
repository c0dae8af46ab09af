"""The whole jobs: import; train, evaluate and score; and the feature study.

``spark-submit ledgerlens/plans/run.py import CSV_FOLDER STORE``, ``score STORE OUT`` or
``study STORE OUT``; ``score STORE OUT --bundle OUT/bundle`` scores with a stored model.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.sampling import balance_classes, positional_split
from ledgerlens.operators.selection import SELECTION_ONES, correlation_report, select_features
from ledgerlens.plans import study, training
from ledgerlens.plans.bundle import Bundle, load_scaler, save_scaler
from ledgerlens.plans.matrix import build_features
from ledgerlens.plans.random_trees import TREES, random_tree_importance
from ledgerlens.plans.staged import split_counts
from ledgerlens.plans.training import PLAIN_BOOST, BoostParams
from ledgerlens.sources.schemas import TABLES
from ledgerlens.sources.tables import (
    DatasetSpec,
    cached_features,
    import_tables,
    inputs_fingerprint,
    load_inputs,
    split_columns,
    write_scores,
)


@dataclass(frozen=True)
class RunOptions:
    lite: bool = False
    cache: bool = True
    use_segment: bool = True
    selection_ones: int | None = SELECTION_ONES
    balance_factor: float = 1.0
    params: BoostParams = field(default_factory=BoostParams)
    grid: Mapping[str, Sequence] | None = None
    predict: bool = True


def stored_features(spark: SparkSession, store: str, spec: DatasetSpec, cache: bool = True) -> DataFrame:
    """The scaled matrix of ``spec`` from the store's cache, built with its scaler if it is missing."""
    inputs = load_inputs(spark, store, spec)

    def build() -> DataFrame:
        matrix, scaler = build_features(inputs)
        save_scaler(spark, scaler, _scaler_path(store, spec))
        return matrix

    return cached_features(
        spark, f"{store}/features", spec, build, cache, fingerprint=inputs_fingerprint(inputs))


def _scaler_path(store: str, spec: DatasetSpec) -> str:
    return f"{store}/features/{spec.features}.scaler"


def train_and_score(
    spark: SparkSession, store: str, out: str, options: RunOptions = RunOptions()
) -> DataFrame:
    """Train on the store, write the model, the sweep and the scores to ``out``; returns the sweep.

    ``out/bundle`` is the model with its columns and scaler, for :func:`score_stored`.
    """
    spec = DatasetSpec(lite=options.lite)
    matrix = stored_features(spark, store, spec, options.cache)
    chosen = select_features(
        matrix, split_columns(matrix)[0], options.use_segment, options.selection_ones)
    params = options.params
    if options.grid:
        found = training.grid_search(
            matrix, chosen, options.grid, params, max_ones=training.GRID_ONES, store=f"{out}/grid")
        params = params.tuned(training.best_point(found, options.grid))
    train, test = positional_split(matrix)
    model = training.train_boosted(train, test, chosen, params, options.balance_factor)
    bundle = Bundle(model, chosen, load_scaler(spark, _scaler_path(store, spec)),
                    inputs_fingerprint(load_inputs(spark, store, spec)))
    bundle.save(spark, f"{out}/bundle")
    training.cap_sweep(model, test, chosen).write.mode("overwrite").parquet(f"{out}/sweep")
    if options.predict:
        score_stored(spark, store, f"{out}/bundle", out, options.cache)
    return spark.read.parquet(f"{out}/sweep")


def score_stored(spark: SparkSession, store: str, bundle: str, out: str, cache: bool = True,
                 own_scale: bool = True) -> DataFrame:
    """Write the scores of the store's unlabelled set by a stored model; returns them.

    The set is scaled by its own statistics, or by those of the training set with ``own_scale=False``.
    """
    stored, spec = Bundle.load(spark, bundle), DatasetSpec(training=False)
    if own_scale:
        matrix = stored_features(spark, store, spec, cache)
    else:
        matrix = build_features(load_inputs(spark, store, spec), stored.scaler)[0]
    scores = stored.score(matrix)
    write_scores(scores, f"{out}/scores")
    return scores


def feature_study(
    spark: SparkSession, store: str, out: str, lite: bool = False,
    boost: BoostParams = PLAIN_BOOST, epochs: int = training.NETWORK_EPOCHS, trees: int = TREES,
    max_ones: int | None = study.STUDY_ONES,
) -> None:
    """Write correlations and the importances to ``out``; that of the booster counts splits, or sums gains.

    The models see ``max_ones`` rows of each class; None balances all labelled rows.
    """
    matrix = stored_features(spark, store, DatasetSpec(lite=lite))
    features, _ = split_columns(matrix)
    sample = balance_classes(matrix, max_ones=max_ones)
    fitted = boost.classifier(sample.count()).fit(training.to_vectors(sample, features))
    network = training.train_network(sample, features, epochs)
    tables = {
        "correlation": correlation_report(balance_classes(matrix), features),
        "forest": study.top_importances(random_tree_importance(sample, features, trees)),
        "boosted": split_counts(fitted, features),
        "boosted_gain": study.boosted_importance(fitted, sample, features),
        "permutation": study.permutation_importance(network, sample, features),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")


def import_folder(spark: SparkSession, folder: str, store: str, names: Sequence[str] | None = None,
                  files: int | None = None) -> None:
    """Import ``<table>.csv`` of the folder, by default of every table, into the store."""
    import_tables(spark, {t: f"{folder}/{t}.csv" for t in names or TABLES}, store, files)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["import", "score", "study"])
    parser.add_argument("store", help="folder written by import; for import, the folder of the CSV files")
    parser.add_argument("out", help="folder for the results; for import, the store to write")
    parser.add_argument("--tables", nargs="+", choices=sorted(TABLES), help="import only these")
    parser.add_argument("--files", type=int, help="files of imported transactions (default: by input size)")
    parser.add_argument("--lite", action="store_true", help="use the small training tables")
    parser.add_argument("--no-cache", action="store_true", help="build the features anew")
    parser.add_argument("--no-segment", action="store_true", help="leave the segment out")
    parser.add_argument("--grid", action="store_true", help="tune on the full grid first; goes on where it was stopped")
    parser.add_argument("--bundle", help="score with this stored model and train nothing")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("ledgerlens").config(
        "spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.job == "import":
        import_folder(spark, args.store, args.out, args.tables, args.files)
    elif args.job == "study":
        feature_study(spark, args.store, args.out, args.lite)
    elif args.bundle:
        score_stored(spark, args.store, args.bundle, args.out, not args.no_cache)
    else:
        train_and_score(spark, args.store, args.out, RunOptions(
            lite=args.lite, cache=not args.no_cache, use_segment=not args.no_segment,
            grid=training.GRID if args.grid else None,
        ))


if __name__ == "__main__":
    main()
