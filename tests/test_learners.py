"""Random trees against a plain tree with the same draws; the network against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.draws import draw, drawn
from ledgerlens.plans import network, random_trees
from ledgerlens.plans.network import Network

FEATURES = ["noise", "signal", "rough", "constant"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 90)
    return [(i, float(rng.normal()), float(y[i] + rng.normal()), float(round(y[i] + rng.normal())), 7.0, int(y[i]))
            for i in range(90)] + [(200, 0.5, 0.5, 1.0, 7.0, 0), (201, 0.5, 0.5, 1.0, 7.0, 1), (202, 0.0, 0.0, 0.0, 7.0, None)]


@pytest.fixture(scope="module")
def sample(spark, rows):
    return spark.createDataFrame(
        rows, "id bigint, noise double, signal double, rough double, constant double, var_rpta int").cache()


def test_draws_are_the_same_in_both(spark):
    df = spark.createDataFrame([(1, "01"), (22, "")], "a int, b string")
    got = [r.u for r in df.select(draw(F.lit(7), F.col("a"), F.col("b"), F.lit("x")).alias("u")).collect()]
    assert got == [drawn(7, 1, "01", "x"), drawn(7, 22, "", "x")]


def plain_gain(y, low):
    gini = lambda part: 2 * part.sum() * (len(part) - part.sum()) / len(part) if len(part) else 0.0
    return gini(y) - gini(y[low]) - gini(y[~low])


def plain_tree(x, y, tree, looked_at, seed, path="", gains=None):
    """Gains by feature of one tree, grown node by node."""
    gains = {} if gains is None else gains
    width = x.shape[1]
    varying = [i for i in range(width) if x[:, i].min() < x[:, i].max()]
    if y.min() == y.max() or not varying:
        return gains
    best = None
    order = sorted(varying, key=lambda i: drawn(seed, tree, path, i, "feature"))[:looked_at]
    for turn, i in enumerate(order):
        lo, hi = x[:, i].min(), x[:, i].max()
        threshold = lo + drawn(seed, tree, path, i, "threshold") * (hi - lo)
        low = x[:, i] <= (threshold if threshold < hi else lo)
        rated = (plain_gain(y, low), -turn, i, low)
        if best is None or rated[:2] > best[:2]:
            best = rated
    gain, _, i, low = best
    gains[i] = gains.get(i, 0.0) + gain
    plain_tree(x[low], y[low], tree, looked_at, seed, path + "0", gains)
    plain_tree(x[~low], y[~low], tree, looked_at, seed, path + "1", gains)
    return gains


@pytest.mark.parametrize("seed", [1, 5])
def test_importances_equal_those_of_plain_trees(sample, rows, seed):
    x = np.array([r[1:5] for r in rows if r[5] is not None])
    y = np.array([float(r[5]) for r in rows if r[5] is not None])
    want = np.zeros(4)
    for tree in range(6):
        gains = plain_tree(x, y, tree, random_trees.features_looked_at(4), seed)
        for i, gain in gains.items():
            want[i] += gain / sum(gains.values()) / 6
    got = {r.feature: r.importance for r in random_trees.random_tree_importance(sample, FEATURES, 6, seed).collect()}
    assert [got[f] for f in FEATURES] == pytest.approx(list(want), abs=1e-9)
    assert got["constant"] == 0 and sum(got.values()) == pytest.approx(1)


def test_trees_without_a_split(spark, sample):
    got = random_trees.random_tree_importance(sample.where("var_rpta = 1"), FEATURES, 2).collect()
    assert [r.importance for r in got] == [0.0] * 4


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    net = Network.fresh((3, 5, 4, 1), 7)
    net = Network(net.layers, net.weights + rng.normal(0, 0.1, len(net.weights)))
    x, y = rng.normal(size=(11, 3)), rng.integers(0, 2, 11).astype(float)
    _, gradient = net.loss_and_gradient(x, y)
    for at in range(len(net.weights)):
        nudge = np.zeros_like(net.weights)
        nudge[at] = 1e-6
        up, down = (Network(net.layers, net.weights + s * nudge).loss_and_gradient(x, y)[0] for s in (1, -1))
        assert gradient[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_distributed_gradient_is_that_of_all_rows(spark, parts):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200).astype(float)
    net = Network.fresh((3, 6, 1), 1)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>")
    n, loss, gradient = network.gradient_of(net, df.repartition(parts))
    want_loss, want = net.loss_and_gradient(x, y)
    assert n == 200 and loss == pytest.approx(want_loss) and gradient == pytest.approx(want)
    assert network.gradient_of(net, df.limit(0))[0] == 0
