"""Small hand-made inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

TRXN = ("id bigint, fecha_trxn timestamp_ntz, canal string, disposit string, "
        "cdgtrn int, cdgrpta int, vlrtran double, sesion int")
CODES = ("canal string, disposit string, cdgtrn int, cdgrpta int, clasif_trxn string, "
         "clasif_cod_rpta string, culpa_banco string, descripcion_grupo string, "
         "producto_asociado string")
LABELS = "id bigint, f_analisis int, var_rpta int, segmento int"


def at(text: str | None) -> datetime | None:
    """'2019-03-04 10:00' or None."""
    return None if text is None else datetime.fromisoformat(text)


def trxn(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Transactions from partial rows; ``t`` is the time as text."""
    full = [
        (r.get("id", 1), at(r.get("t")), r.get("canal", "web"), r.get("disposit", "D0"),
         r.get("cdgtrn", 1), r.get("cdgrpta", 1), r.get("vlrtran", 1.0), r.get("sesion", 1))
        for r in rows
    ]
    return spark.createDataFrame(full, TRXN)


def times(spark: SparkSession, *texts: str | None, **common) -> DataFrame:
    return trxn(spark, [{"t": t, **common} for t in texts])


def codes(spark: SparkSession, rows: list[dict]) -> DataFrame:
    full = [
        (r.get("canal", "web"), r.get("disposit", "D0"), r.get("cdgtrn", 1), r.get("cdgrpta", 1),
         r.get("clasif_trxn", "Financiera"), r.get("clasif_cod_rpta", "Exitosa"),
         r.get("culpa_banco"), r.get("grupo", "Retiros"), r.get("producto", "Credito"))
        for r in rows
    ]
    return spark.createDataFrame(full, CODES)


def labels(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), LABELS)


def one(df: DataFrame) -> dict:
    """The only row."""
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()
