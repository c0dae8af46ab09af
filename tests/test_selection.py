"""Correlation, F scores and the choice of columns against numpy."""

import random

import numpy as np
import pytest

from ledgerlens.operators import selection

NAMES = ["signal", "noise", "weak", "constant"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    y = np.arange(400) % 2
    x = np.column_stack([y + rng.normal(size=400), rng.normal(size=400),
                         y * 0.3 + rng.normal(size=400), np.full(400, 0.1)])
    return x, y


@pytest.fixture(scope="module")
def sample(spark, data):
    x, y = data
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(len(y))]
    columns = ", ".join(f"{n} double" for n in NAMES)
    return spark.createDataFrame(rows, f"id bigint, {columns}, var_rpta int")


def test_correlation(sample, data):
    x, y = data
    got = {r.feature: r.corr for r in selection.label_correlations(sample, NAMES).collect()}
    for i, name in enumerate(NAMES[:3]):
        assert got[name] == pytest.approx(np.corrcoef(x[:, i], y)[0, 1])
    assert got["constant"] is None
    report = {r.feature: r.abs_corr for r in selection.correlation_report(sample, NAMES).collect()}
    assert report["var_rpta"] == pytest.approx(1)


def test_correlation_matrix(sample, data):
    x, _ = data
    got = {(r.feature_a, r.feature_b): r.corr for r in selection.correlation_matrix(sample, NAMES).collect()}
    assert len(got) == 9
    assert got["signal", "weak"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 2])[0, 1])


def test_f_scores(sample, data):
    x, y = data
    got = {r.feature: r.f_score for r in selection.f_scores(sample, NAMES).collect()}
    assert set(got) == set(NAMES[:3])
    r = np.corrcoef(x[:, 0], y)[0, 1]
    assert got["signal"] == pytest.approx(r * r / (1 - r * r) * 398)


def test_selection(sample, data):
    x, y = data
    strength = np.abs([np.corrcoef(x[:, i], y)[0, 1] for i in range(3)])
    top = [r.feature for r in selection.top_f_scores(sample, NAMES, 2).collect()]
    assert top == [NAMES[i] for i in np.argsort(-strength)[:2]]
    above = {r.feature for r in selection.corr_above_mean(sample, NAMES).collect()}
    assert above == {NAMES[i] for i in range(3) if strength[i] > strength.mean()}
    chosen = selection.select_features(sample, NAMES)
    assert chosen == sorted(NAMES[:3])
    renamed = sample.withColumnRenamed("weak", "segmento")
    names = ["signal", "noise", "segmento"]
    assert "segmento" not in selection.select_features(renamed, names, use_segment=False)


@pytest.mark.parametrize("block", [1, 2, 64])
def test_correlation_matrix_by_blocks(spark, monkeypatch, block):
    rng = random.Random(9)
    rows = [(float(i), rng.random(), 3.0 - 2 * i, rng.random() + i / 50, 5.0) for i in range(101)]
    df = spark.createDataFrame(rows, "`a` double, b double, c double, d double, e double").repartition(5)
    monkeypatch.setattr(selection, "BLOCK_COLUMNS", block)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in selection.correlation_matrix(df, list("abcde")).collect()}
    want = np.corrcoef(np.array(rows)[:, :4].T)
    assert got == pytest.approx({(x, y): want[i, j] for i, x in enumerate("abcd") for j, y in enumerate("abcd")})
    assert selection.correlation_matrix(df, ["e"]).collect() == []
