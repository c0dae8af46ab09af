"""Staged scores of boosted models, patience, and the stored grid against plain counterparts."""

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from ledgerlens.operators.sampling import positional_split, stratified_folds
from ledgerlens.plans import staged, training
from ledgerlens.session import Scratch

FEATURES = ["noise", "signal", "rough"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 500)
    rows = [(i, float(rng.normal()), float(y[i] + rng.normal()), float(round(y[i] + rng.normal())), int(y[i]))
            for i in range(500)]
    return spark.createDataFrame(
        rows, "id bigint, noise double, signal double, rough double, var_rpta int").cache()


@pytest.fixture(scope="module")
def fitted(matrix):
    rows = training.to_vectors(matrix, FEATURES).cache()
    return training.BoostParams(rounds=25, step_size=0.3).classifier(500).fit(rows), rows


def plain_area(labels, scores):
    pairs = [(a > b) + (a == b) / 2 for a, la in zip(scores, labels) if la for b, lb in zip(scores, labels) if not lb]
    return sum(pairs) / len(pairs)


def test_margins_end_with_those_of_the_model(fitted):
    model, rows = fitted
    staged_rows = staged.staged_margins(model, rows).collect()
    raw = [r.rawPrediction[1] for r in model.transform(rows).select("rawPrediction").collect()]
    assert sorted(r.margins[-1] for r in staged_rows) == pytest.approx(sorted(raw), abs=1e-12)
    assert {len(r.margins) for r in staged_rows} == {25}
    some = staged.staged_margins(model, rows, [3, 25]).collect()
    assert [list(r.margins) for r in some] == [[r.margins[2], r.margins[24]] for r in staged_rows]


def test_areas_equal_those_of_all_pairs(fitted):
    model, rows = fitted
    got = staged.areas_by_round(model, rows)
    plain = staged.staged_margins(model, rows).collect()
    for at in (0, 4, 24):
        assert got[at] == pytest.approx(plain_area([r.label for r in plain], [r.margins[at] for r in plain]), abs=1e-12)


def test_areas_of_groups(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 0.5), ("a", 0.0, 0.5), ("a", 0.0, 0.1), ("b", 1.0, 0.2), ("b", 1.0, 0.3)] * 50,
        "g string, label double, score double")
    with Scratch(spark) as scratch:
        got = {r.g: r.auc for r in staged.grouped_areas(scratch, rows, ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}


@pytest.mark.parametrize("values, patience, want", [
    ([0.5, 0.6, 0.6, 0.6, 0.9], 2, (2, True)),
    ([0.5, 0.6, 0.6, 0.7, 0.9], 2, (5, False)),
    ([0.9, 0.1, 0.1], 5, (1, False)),
    ([0.9, 0.1, 0.1, 0.1], 1, (1, True)),
    ([0.1] * 200, 60, (1, True)),
    ([0.7], 60, (1, False)),
])
def test_best_round(values, patience, want):
    assert staged.best_round(values, patience) == want


@pytest.mark.parametrize("patience", [1, 4])
def test_training_ends_by_patience(matrix, patience):
    """As many trees as a plain scan of the area after each round of a long fit."""
    train, test = positional_split(matrix)
    params = training.BoostParams(rounds=60, patience=patience, step_size=0.3)
    model = training.train_boosted(train, test, FEATURES, params)
    from ledgerlens.operators.sampling import balance_classes
    fit, check = balance_classes(train), training.to_vectors(balance_classes(test), FEATURES)
    whole = params.classifier(fit.count()).fit(training.to_vectors(fit, FEATURES))
    rows = staged.staged_margins(whole, check).collect()
    areas = [plain_area([r.label for r in rows], [r.margins[i] for r in rows]) for i in range(60)]
    best = 0
    for at in range(60):
        if areas[at] > areas[best]:
            best = at
        if at - best >= patience:
            break
    assert model.getNumTrees == best + 1


def test_split_counts_equal_the_printed_trees(fitted):
    model, _ = fitted
    got = {r.feature: r.splits for r in staged.split_counts(model, FEATURES).collect()}
    text = model.toDebugString
    want = {name: text.count(f"If (feature {i} ") for i, name in enumerate(FEATURES)}
    assert got == {name: n for name, n in want.items() if n}
    assert sum(r.importance for r in staged.split_counts(model, FEATURES).collect()) == pytest.approx(1)


GRID = {"max_depth": [1, 2], "rounds": [2, 5]}


def test_grid_equals_single_fits(matrix):
    found = {(r.params["max_depth"], r.params["rounds"]): r.log_loss
             for r in training.grid_search(matrix, FEATURES, GRID).collect()}
    assert len(found) == 4
    sample = stratified_folds(training.balance_classes(matrix, max_ones=training.GRID_ONES), 3)
    rows = training.to_vectors(sample, FEATURES).join(sample.select("id", "fold"), "id").cache()
    n = rows.count()
    evaluator = MulticlassClassificationEvaluator(metricName="logLoss")
    for (depth, rounds), loss in found.items():
        params = training.BoostParams(max_depth=int(depth), rounds=int(rounds))
        single = [evaluator.evaluate(params.classifier(n).fit(rows.where(F.col("fold") != f)).transform(
            rows.where(F.col("fold") == f))) for f in range(3)]
        assert loss == pytest.approx(sum(single) / 3, abs=1e-9)


def test_grid_goes_on_where_it_was_stopped(matrix, tmp_path, monkeypatch):
    store = str(tmp_path / "grid")
    fits = []
    plain = training.losses_at

    def stopping(model, rows, rounds):
        fits.append(1)
        if len(fits) == 4:
            raise RuntimeError("killed")
        return plain(model, rows, rounds)

    monkeypatch.setattr(training, "losses_at", stopping)
    with pytest.raises(RuntimeError):
        training.grid_search(matrix, FEATURES, GRID, parallelism=1, store=store)
    first = len(fits) - 1
    monkeypatch.setattr(training, "losses_at", lambda *a: fits.append(1) or plain(*a))
    fits.clear()
    again = training.grid_search(matrix, FEATURES, GRID, parallelism=1, store=store).collect()
    assert first >= 3 and len(fits) <= 3 and len(again) == 4
    fits.clear()
    assert training.grid_search(matrix, FEATURES, GRID, store=store).collect() == again and not fits
    monkeypatch.setattr(training, "losses_at", plain)
    fresh = training.grid_search(matrix, FEATURES, GRID).collect()
    assert [r.params for r in fresh] == [r.params for r in again]
