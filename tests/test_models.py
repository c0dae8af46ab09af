"""Models on a planted signal: bounds and properties, not values."""

import numpy as np
import pytest

from ledgerlens.operators.sampling import balance_classes, positional_split
from ledgerlens.plans import study, training
from ledgerlens.plans.random_trees import random_tree_importance

FEATURES = ["noise", "signal"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    rows = [(i, float(rng.normal()), float(2 * y[i] + rng.normal()), int(y[i])) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, noise double, signal double, var_rpta int").cache()


@pytest.fixture(scope="module")
def boosted(matrix):
    train, test = positional_split(matrix)
    return training.train_boosted(train, test, FEATURES, training.BoostParams(rounds=15)), train, test


def test_boosted_scores(matrix, boosted):
    model, train, test = boosted
    scores = training.score(model, test, FEATURES).cache()
    assert training.area_under_roc(scores) > 0.8
    for row in scores.collect():
        assert 0 <= row.probabilidad <= 1
        assert row.clase == round(row.probabilidad)
    again = training.train_boosted(train, test, FEATURES, training.BoostParams(rounds=15))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(training.score(again, test, FEATURES)) == key(scores)


class _Half:
    """A model that gives every row the probability one half."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        from pyspark.sql import functions as F
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))


def test_half_is_class_zero(matrix):
    scores = training.score(_Half(), matrix.limit(3), FEATURES).collect()
    assert [(r.probabilidad, r.clase) for r in scores] == [(0.5, 0)] * 3


def test_area_is_exact(spark):
    scores = spark.range(5000).selectExpr("cast(id % 7 < 3 as double) label", "(id * 7919 % 5000) / 5000.0D probabilidad")
    rows = scores.collect()
    ones, zeros = ([r.probabilidad for r in rows if r.label == y] for y in (1, 0))
    order = np.argsort(np.argsort(ones + zeros))[:len(ones)]
    want = (order.sum() - len(ones) * (len(ones) - 1) / 2) / len(ones) / len(zeros)
    assert training.area_under_roc(scores) == pytest.approx(want, abs=1e-12)


def test_cap_sweep(boosted):
    model, _, test = boosted
    caps = (5, 50, 1600)
    rows = {r.cap: r for r in training.cap_sweep(model, test, FEATURES, caps).collect()}
    assert set(rows) == set(caps)
    for cap, row in rows.items():
        sample = training.score(model, balance_classes(test, cap), FEATURES).collect()
        assert row.n == len(sample)
        assert row.wrong == sum(r.clase != r.label for r in sample)
        assert row.predicted_ones == sum(r.clase == 1 for r in sample)
        assert row.expected_ones == sum(r.label == 1 for r in sample)
        assert row.error == pytest.approx(row.wrong / row.n)


def test_importances(matrix, boosted):
    for table in (study.boosted_importance(boosted[0], matrix, FEATURES),
                  random_tree_importance(matrix, FEATURES, trees=10)):
        got = {r.feature: r.importance for r in table.collect()}
        assert sum(got.values()) == pytest.approx(1)
        assert got["signal"] > got["noise"]
        assert [r.feature for r in study.top_importances(table, 1).collect()] == ["signal"]


def test_permutation_importance(matrix, boosted):
    got = {r.feature: r for r in study.permutation_importance(
        boosted[0], matrix, FEATURES, repeats=3).collect()}
    assert got["signal"].importance > 0.2
    assert abs(got["noise"].importance) < 0.05


@pytest.fixture(scope="module")
def network(matrix):
    return training.train_network(matrix, FEATURES)


def test_network(matrix, network):
    assert network.getLayers() == [2, *training.HIDDEN_LAYERS, 1]
    scores = training.score(network, matrix, FEATURES).collect()
    assert sum(r.clase == r.label for r in scores) > 0.8 * len(scores)


def test_network_permutation(matrix, network):
    got = {r.feature: r.importance for r in study.permutation_importance(network, matrix, FEATURES, repeats=2).collect()}
    assert got["signal"] > 0.2 > abs(got["noise"])


def test_grid_search(matrix):
    found = training.grid_search(
        matrix, FEATURES, {"max_depth": [1, 2]}, training.BoostParams(rounds=3)).collect()
    assert len(found) == 2
    assert found[0].log_loss <= found[1].log_loss
    assert {r.params["max_depth"] for r in found} == {"1", "2"}


def test_full_run(matrix):
    model, sweep = training.train_and_evaluate(matrix, FEATURES, training.BoostParams(rounds=3))
    assert sweep.count() == len(training.SWEEP_CAPS)
