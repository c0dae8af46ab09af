"""Trees whose large nodes are split in passes over all rows are those that one task grows."""

import numpy as np
import pytest

from ledgerlens.plans import random_trees
from test_learners import plain_tree

FEATURES = ["noise", "signal", "rough", "constant"]
TREES = 4


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    return [(i, float(rng.normal()), float(y[i] + rng.normal()), float(round(y[i] + rng.normal())), 7.0, int(y[i]))
            for i in range(300)] + [(i, 0.5, 0.5, 1.0, 7.0, i % 2) for i in range(300, 330)] + [(400, 0.0, 0.0, 0.0, 7.0, None)]


@pytest.mark.parametrize("most", [330, 329, 40, 12])
def test_importances_equal_those_of_plain_trees(spark, rows, most):
    x, y = np.array([r[1:5] for r in rows[:-1]]), np.array([float(r[5]) for r in rows[:-1]])
    want = np.zeros(4)
    for tree in range(TREES):
        gains = plain_tree(x, y, tree, random_trees.features_looked_at(4), 3)
        for i, gain in gains.items():
            want[i] += gain / sum(gains.values()) / TREES
    sample = spark.createDataFrame(
        rows, "id bigint, noise double, signal double, rough double, constant double, var_rpta int").repartition(3)
    found = random_trees.random_tree_importance(sample, FEATURES, TREES, 3, node_bytes=most * 5 * 8)
    got = {r.feature: r.importance for r in found.collect()}
    assert [got[f] for f in FEATURES] == pytest.approx(list(want), abs=1e-9)
