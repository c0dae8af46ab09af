"""Entries of a wide dimension against the dense columns, and a dimension of 50,000 values."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.operators import codes, selection, sparse
from ledgerlens.operators.sampling import balance_classes
from ledgerlens.operators.scaling import Scaler
from ledgerlens.plans.training import BoostParams
from ledgerlens.sources.mapping import inputs_from_events

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def both(spark):
    """Dense flags of every labelled id with zeros, their columns, and the entries."""
    inputs = inputs_from_events(spark, FOLDER)
    table = codes.code_table(inputs.dimension)
    labels = inputs.labels.select("id", "var_rpta")
    dense = labels.join(codes.group_flags(inputs.transactions, table, fraction=True), "id", "left").na.fill(0.0).cache()
    return dense, table.generated, sparse.group_entries(inputs.transactions, inputs.dimension, fraction=True).cache()


def test_entries_and_statistics(both):
    dense, columns, entries = both
    ids = dense.select("id")
    got = {(r.id, r.feature): r.value for r in entries.join(ids, "id").collect()}
    want = {(r.id, c): r[c] for r in dense.collect() for c in columns if r[c]}
    assert got == pytest.approx(want) and got
    scaler = Scaler.fit(dense, columns)
    statistics = sparse.entry_statistics(entries.join(ids, "id"), dense.count())
    for r in statistics.collect():
        assert r["mean"] == pytest.approx(scaler.means[r.feature])
        assert r.deviation == pytest.approx(scaler.deviations[r.feature], abs=1e-9)
    scaled = {(r.id, r.feature): r.value + r.offset for r in sparse.scaled_entries(entries.join(ids, "id"), statistics).collect()}
    for r in scaler.transform(dense).collect():
        for c in columns:
            if (r.id, c) in scaled:
                assert scaled[r.id, c] == pytest.approx(r[c])


def test_correlations_and_selection(both):
    dense, columns, entries = both
    sample = balance_classes(dense)
    want = {r.feature: r for r in selection.label_correlations(sample, columns).collect()}
    scored = sparse.entry_correlations(entries, sample.select("id", "var_rpta"))
    for r in scored.collect():
        assert r["corr"] == pytest.approx(want[r.feature]["corr"], abs=1e-9)
        assert r.n == want[r.feature].n and r.mean_abs_corr == pytest.approx(want[r.feature].mean_abs_corr)
    names = lambda df: sorted(r.feature for r in df.collect())
    assert names(selection.selected_of(scored)) == names(selection.selected_features(sample, columns))


def test_training_on_sparse_vectors_equals_dense(both, spark):
    dense, columns, entries = both
    chosen = spark.createDataFrame([(c,) for c in columns], "feature string")
    rows, places = sparse.sparse_vectors(entries, chosen, dense.select("id", "var_rpta"))
    assert [r.feature for r in places.orderBy("position").collect()] == sorted(columns)
    plain = VectorAssembler(inputCols=sorted(columns), outputCol="features").transform(dense).select(
        "id", F.col("var_rpta").cast("double").alias("label"), "features")
    scores = []
    for frame in (rows, plain):
        frame = frame.orderBy("id").coalesce(1)
        model = BoostParams(rounds=3).classifier(frame.count()).fit(frame)
        scores.append({r.id: r.probability[1] for r in model.transform(frame).collect()})
    assert scores[0] == pytest.approx(scores[1])


def test_fifty_thousand_values(spark):
    """Twice 50,000 columns: counted, selected and trained on without their names on the driver."""
    wide = 50_000
    dimension = spark.range(wide).selectExpr(
        "concat('c', id % 10) canal", "'d' disposit", "cast(id as int) cdgtrn", "0 cdgrpta", "'x' clasif_trxn",
        "'y' clasif_cod_rpta", "'NO' culpa_banco", "concat('Group ', id) descripcion_grupo",
        "concat('Product ', id) producto_asociado")
    trxn = spark.range(100_000).selectExpr(
        "cast(id % 2000 as int) id", f"concat('c', (id * 7919) % {wide} % 10) canal", "'d' disposit",
        f"cast(if(id % 2000 % 2 = 1 and id < 20000, 7, (id * 7919) % {wide}) as int) cdgtrn", "0 cdgrpta")
    trxn = trxn.withColumn("canal", F.concat(F.lit("c"), F.col("cdgtrn") % 10))
    labels = spark.range(2000).selectExpr("cast(id as int) id", "cast(id % 2 as int) var_rpta")
    entries = sparse.group_entries(trxn, dimension, fraction=True).cache()
    assert entries.select("feature").distinct().count() > 60_000
    scored = sparse.entry_correlations(entries, labels).cache()
    assert scored.orderBy(F.desc(F.abs("corr")), "feature").first().feature in ("ratio_dg_group_7", "ratio_pa_product_7")
    chosen = selection.f_scores_of(scored).orderBy(F.desc("f_score"), "feature").limit(10)
    rows, _ = sparse.sparse_vectors(entries, chosen, labels)
    model = BoostParams(rounds=2, column_share=1.0).classifier(2000).fit(rows)
    right = model.transform(rows).where("prediction = label").count()
    assert right > 1900
    assert np.isfinite(right)
