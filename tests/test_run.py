"""Both whole jobs from typed tables to written results."""

import pytest

from pyspark.sql import functions as F

from ledgerlens.plans.bundle import Bundle
from ledgerlens.plans.run import RunOptions, feature_study, import_folder, score_stored, train_and_score
from ledgerlens.plans.training import GRID, SWEEP_CAPS, BoostParams
from ledgerlens.sources.mapping import inputs_from_events
from ledgerlens.sources.schemas import CODE_DIMENSION
from ledgerlens.sources.tables import DIMENSION, DatasetSpec

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    for training in (True, False):
        inputs, spec = inputs_from_events(spark, FOLDER, training), DatasetSpec(training)
        inputs.transactions.write.parquet(f"{path}/{spec.transactions}")
        inputs.labels.write.parquet(f"{path}/{spec.labels}")
    inputs.dimension.write.parquet(f"{path}/{DIMENSION}")
    return path


def test_train_and_score(spark, store, tmp_path):
    out = str(tmp_path / "out")
    options = RunOptions(params=BoostParams(rounds=3), grid={"max_depth": [1, 2], "rounds": [2]})
    sweep = train_and_score(spark, store, out, options)
    assert sorted(r.cap for r in sweep.collect()) == list(SWEEP_CAPS)
    scores = spark.read.option("header", True).csv(f"{out}/scores")
    ids = spark.read.parquet(f"{store}/ids_predict").count()
    assert scores.columns == ["id", "probabilidad"] and scores.count() >= ids


def test_stored_model(spark, store, tmp_path):
    """A new session scores as the one that trained, without training."""
    out, other = str(tmp_path / "out"), spark.newSession()
    train_and_score(spark, store, out, RunOptions(params=BoostParams(rounds=3)))
    other.conf.set("spark.sql.session.timeZone", "UTC")
    score_stored(other, store, f"{out}/bundle", str(tmp_path / "again"))
    rows = lambda path: sorted(tuple(r) for r in spark.read.csv(path, header=True).collect())
    assert rows(f"{out}/scores") == rows(f"{tmp_path}/again/scores") != []
    bundle = Bundle.load(other, f"{out}/bundle")
    assert bundle.fingerprint and set(bundle.features) <= set(bundle.scaler.means)
    scaled = score_stored(other, store, f"{out}/bundle", str(tmp_path / "scaled"), own_scale=False)
    assert scaled.count() == len(rows(f"{out}/scores"))
    with pytest.raises(ValueError, match="lacks"):
        bundle.score(spark.range(3).withColumn("x", F.lit(1.0)))


def test_feature_study(spark, store, tmp_path):
    out = str(tmp_path / "study")
    feature_study(spark, store, out, boost=BoostParams(rounds=3), epochs=2, trees=5)
    assert spark.read.parquet(f"{out}/correlation").where("feature = 'var_rpta'").first().abs_corr == pytest.approx(1)
    for name in ("forest", "boosted", "boosted_gain", "permutation"):
        assert spark.read.parquet(f"{out}/{name}").count() > 0


def test_tuned_parameters():
    params = BoostParams(rounds=7).tuned({"max_depth": 4, "step_size": 0.5, "rounds": 20})
    assert params == BoostParams(rounds=7, max_depth=4, step_size=0.5)
    base = BoostParams()
    same = {k: getattr(base, k) for k in GRID}
    assert base.tuned(same) == base and base.tuned(same).spark_values(500) == base.spark_values(500)


def test_import_job(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "maestro_cdgtrn_cdgrpta.csv").write_text(
        ",".join(CODE_DIMENSION.fieldNames()) + "\n"
        'web,D0,None,3.5,"He said ""hi"", ok","two\nlines \\ here",Financiera,Pagos,,Exitosa,,SI,Credito\n')
    import_folder(spark, str(folder), str(tmp_path / "store"), ["maestro_cdgtrn_cdgrpta"])
    row = spark.read.parquet(str(tmp_path / "store" / "maestro_cdgtrn_cdgrpta")).first()
    assert (row.cdgtrn, row.cdgrpta) == (-1, 4)
    assert 'He said "hi", ok' in tuple(row) and "two\nlines \\ here" in tuple(row)
