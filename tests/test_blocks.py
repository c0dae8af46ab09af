"""A task that steps along a block of batches does what a job for each step does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import shuffled_positions
from ledgerlens.plans import network, study
from ledgerlens.plans.network import Network


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 90)
    return spark.createDataFrame(
        [(i, float(y[i]), [float(rng.normal()), float(y[i] + rng.normal())]) for i in range(90)],
        "id bigint, label double, x array<double>").repartition(3).cache()


def fitted(rows, monkeypatch, rows_of_block):
    monkeypatch.setattr(network, "BLOCK_BYTES", rows_of_block * 2 * 8)
    return network.fit(rows, [2, 5, 1], epochs=3, batch=16, step=0.1, momentum=0.5, seed=3).weights


def test_one_block_steps_as_single_jobs_do(rows, monkeypatch):
    assert fitted(rows, monkeypatch, 96) == pytest.approx(fitted(rows, monkeypatch, 15), abs=1e-12)


def test_blocks_step_as_a_plain_loop_does(spark, rows, monkeypatch):
    placed = shuffled_positions(rows, "id", 3, 90).orderBy("position").collect()
    x, y = np.array([r.x for r in placed]), np.array([r.label for r in placed])
    order = network.random.Random(3)
    net, speed = Network.fresh([2, 5, 1], 3), 0.0
    blocks = [[0, 1], [2, 3], [4, 5]]
    for _ in range(3):
        order.shuffle(blocks)
        for block in blocks:
            order.shuffle(block)
            for number in block:
                some = slice(number * 16, number * 16 + 16)
                _, gradient = net.loss_and_gradient(x[some], y[some])
                speed = 0.5 * speed - 0.1 * gradient / len(y[some])
                net = Network(net.layers, net.weights + speed)
    assert fitted(rows, monkeypatch, 35) == pytest.approx(net.weights, abs=1e-12)


def test_swapped_counts_equal_rows_with_swapped_values(spark, rows, monkeypatch):
    net = network.fit(rows, [2, 5, 1], epochs=8, batch=16, step=0.3, momentum=0.0, seed=3)
    df = rows.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("label").cast("int").alias("var_rpta"))

    class Plain:
        """The same network as a model that only scores."""

        transform = net.transform

    monkeypatch.setattr(network, "SWAPPED_ROWS", 7)
    got, want = (sorted(map(tuple, study.permutation_importance(model, df, ["a", "b"], repeats=2).collect()))
                 for model in (net, Plain()))
    assert [r[0] for r in got] == [r[0] for r in want] == ["a", "b"]
    assert [r[1:] for r in got] == [pytest.approx(r[1:], abs=1e-12) for r in want]
