"""The registered studies see every labelled row, however large a class is."""

import numpy as np
import pytest

from ledgerlens.checks import registry
from ledgerlens.plans import random_trees, study, training

ONES, ZEROS, UNLABELLED = 1100, 1300, 50


class Seen(Exception):
    """Ends a query with the rows that it would have gone on with."""


def seen(df, *_, **__):
    raise Seen({r.var_rpta: r["count"] for r in df.groupBy("var_rpta").count().collect()})


@pytest.fixture
def matrix(spark, monkeypatch):
    rng = np.random.default_rng(6)
    labels = rng.permutation([1] * ONES + [0] * ZEROS + [None] * UNLABELLED)
    rows = [(i, float(rng.normal()), float(rng.normal()), y) for i, y in enumerate(labels.tolist())]
    df = spark.createDataFrame(rows, "id bigint, noise double, signal double, var_rpta int")
    monkeypatch.setattr(registry, "_cached", lambda *_, **__: df)
    return df


def test_grid_search_deals_every_labelled_row(spark, matrix, monkeypatch):
    monkeypatch.setattr(training, "stratified_folds", seen)
    with pytest.raises(Seen) as rows:
        registry.QUERIES["grid_search"](spark, "of a test")
    assert rows.value.args[0] == {0: ZEROS, 1: ONES}
    with pytest.raises(Seen) as rows:
        training.grid_search(matrix, ["noise", "signal"], max_ones=7)
    assert rows.value.args[0] == {0: 7, 1: 7}


def test_forest_sees_every_labelled_row(spark, matrix, monkeypatch):
    monkeypatch.setattr(random_trees, "random_tree_importance", seen)
    with pytest.raises(Seen) as rows:
        registry.QUERIES["forest_importance"](spark, "of a test")
    assert rows.value.args[0] == {0: ZEROS, 1: ONES}


def test_permutations_and_their_network_see_every_labelled_row(spark, matrix, monkeypatch):
    with monkeypatch.context() as patched, pytest.raises(Seen) as rows:
        patched.setattr(training, "train_network", seen)
        registry.QUERIES["permutation_importance"](spark, "of a test")
    assert rows.value.args[0] == {0: ZEROS, 1: ONES}
    monkeypatch.setattr(training, "train_network", lambda *_: None)
    monkeypatch.setattr(study, "permutation_importance", lambda _, df, *__: seen(df))
    with pytest.raises(Seen) as rows:
        registry.QUERIES["permutation_importance"](spark, "of a second test")
    assert rows.value.args[0] == {0: ZEROS, 1: ONES}
