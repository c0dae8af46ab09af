"""The area of the check from ranks, against all pairs."""

import random

import pytest

from ledgerlens.checks import registry


def test_area_by_ranks_equals_all_pairs(spark):
    draw = random.Random(4)
    rows = [(draw.choice([0.0, 1.0, 0.5, draw.random(), draw.random() / 10_000]), draw.randrange(2)) for _ in range(400)]
    scores = spark.createDataFrame(rows, "probabilidad double, label int")
    ones, zeros = ([p for p, y in rows if y == kind] for kind in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    assert registry._ranked_area(scores) == pytest.approx(want, abs=1e-12)
    plan = registry._zeros_below(scores)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
