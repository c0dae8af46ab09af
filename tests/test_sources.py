"""Typed loading, table choice, the feature cache and the score file."""

from decimal import Decimal

import pytest

from frames import codes, labels, trxn
from ledgerlens.plans.matrix import build_features
from ledgerlens.session import require_utc
from ledgerlens.sources import schemas, tables
from ledgerlens.sources.tables import DatasetSpec, Inputs


def csv_file(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


HEADER = "ID,FECHA,CANAL,DISPOSIT,CDGTRN,CDGRPTA,VLRTRAN,SESION\n"


def test_typed_csv(spark, tmp_path):
    path = csv_file(tmp_path, "t.csv", HEADER + "1,2019-03-04 10:00:00.000001,web,,5,,12.345678,7\n")
    row = tables.read_csv(spark, path, schemas.TRANSACTIONS).first()
    assert row.fecha_trxn.microsecond == 1
    assert (row.disposit, row.cdgrpta, row.vlrtran) == (None, None, Decimal("12.345678"))


def test_bad_csv_stops(spark, tmp_path):
    path = csv_file(tmp_path, "t.csv", HEADER + "x,2019-03-04 10:00:00,web,a,5,1,1,7\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, path, schemas.TRANSACTIONS).collect()


@pytest.mark.parametrize("training, lite, names", [
    (True, False, ("datos_transaccionales_train", "datos_var_rpta_train", "features_train")),
    (True, True, ("datos_transaccionales_train_lite", "datos_var_rpta_train_lite", "features_train_lite")),
    (False, True, ("datos_transaccionales_predict", "ids_predict", "features_predict")),
])
def test_table_choice(training, lite, names):
    spec = DatasetSpec(training, lite)
    assert (spec.transactions, spec.labels, spec.features) == names
    assert spec.transactions in schemas.TABLES and spec.labels in schemas.TABLES


def test_import_and_load(spark, tmp_path):
    dimension = ",".join(schemas.CODE_DIMENSION.fieldNames()) + "\nweb,D0,None,2.5,,,Financiera,Retiros,,Exitosa,,SI,Credito\n"
    paths = {
        "maestro_cdgtrn_cdgrpta": csv_file(tmp_path, "m.csv", dimension),
        "datos_transaccionales_train": csv_file(tmp_path, "t.csv", HEADER + "1,2019-03-04 10:00:00,web,D0,-1,3,1,7\n"),
        "datos_var_rpta_train": csv_file(tmp_path, "r.csv", "id,f,v,s\n1,201903,1,2\n"),
    }
    folder = str(tmp_path / "store")
    tables.import_tables(spark, paths, folder)
    spec = DatasetSpec()
    stored = spark.read.parquet(f"{folder}/{tables.DIMENSION}").first()
    assert (stored.cdgtrn, stored.cdgrpta) == (-1, 3)
    inputs = tables.load_inputs(spark, folder, spec)
    assert inputs.transactions.schema == schemas.TRANSACTIONS
    matrix, _ = build_features(inputs)
    assert matrix.count() == 1


def test_load_from_csv_folder(spark, tmp_path):
    for table, schema in schemas.TABLES.items():
        csv_file(tmp_path, f"{table}.csv", ",".join(schema.fieldNames()) + "\n")
    inputs = tables.load_inputs(spark, str(tmp_path), DatasetSpec(training=False), "csv")
    assert inputs.labels.schema == schemas.IDS_TO_SCORE
    assert inputs.dimension.schema["cdgtrn"].dataType.simpleString() == "int"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_cache(spark, tmp_path, fmt):
    inputs = Inputs(trxn(spark, [{"id": 1}, {"id": 2}]), labels(spark, (1, 201901, 1, 0)), codes(spark, [{}]))
    calls = []

    def build():
        calls.append(1)
        return build_features(inputs)[0]

    spec = DatasetSpec()
    runs = [tables.cached_features(spark, str(tmp_path), spec, build, fmt=fmt) for _ in range(2)]
    assert len(calls) == 1
    assert sorted(runs[0].collect()) == sorted(runs[1].collect())
    tables.cached_features(spark, str(tmp_path), spec, build, cache=False, fmt=fmt)
    assert len(calls) == 2
    features, label = tables.split_columns(runs[0])
    assert label == "var_rpta" and features[0] == "total_trxn" and "id" not in features
    assert {runs[0].schema[c].dataType.simpleString() for c in features} == {"double"}


def test_training_statistics_can_be_reused(spark):
    dimension = codes(spark, [{}])
    base = Inputs(trxn(spark, [{"id": 1}, {"id": 2}, {"id": 2}]), labels(spark, (1, 201901, 1, 0)), dimension)
    _, scaler = build_features(base)
    other = Inputs(trxn(spark, [{"id": 5}]), labels(spark, (5, 201901, 1, 0)).drop("var_rpta"), dimension)
    row = build_features(other, scaler)[0].first()
    assert row.total_trxn == -1.0
    assert build_features(other)[0].first().total_trxn == 0.0


def test_scores_file(spark, tmp_path):
    path = str(tmp_path / "scores")
    tables.write_scores(spark.createDataFrame([(1, 0.25, 0)], "id bigint, probabilidad double, clase int"), path)
    assert spark.read.option("header", True).csv(path).collect() == [("1", "0.25")]


def test_other_time_zones_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
    try:
        with pytest.raises(ValueError, match="UTC"):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
