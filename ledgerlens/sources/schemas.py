"""Declared schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_INT, _TEXT = T.IntegerType(), T.StringType()

TRANSACTIONS = _struct(
    id=_INT, fecha_trxn=T.TimestampNTZType(), canal=_TEXT, disposit=_TEXT,
    cdgtrn=_INT, cdgrpta=_INT, vlrtran=T.DecimalType(38, 6), sesion=_INT,
)
LABELS = _struct(id=_INT, f_analisis=_INT, var_rpta=_INT, segmento=_INT)
IDS_TO_SCORE = _struct(id=_INT, f_analisis=_INT, segmento=_INT)
# Codes arrive as text ('None', '100.0') and become integers in clean_codes().
CODE_DIMENSION = _struct(
    canal=_TEXT, disposit=_TEXT, cdgtrn=_TEXT, cdgrpta=_TEXT,
    grupo_descrp_trxn=_TEXT, descrip_trxn=_TEXT, clasif_trxn=_TEXT,
    descripcion_grupo=_TEXT, descrip_cod_rpta=_TEXT, clasif_cod_rpta=_TEXT,
    grupot_modificado=_TEXT, culpa_banco=_TEXT, producto_asociado=_TEXT,
)

TABLES = {
    "datos_transaccionales_train": TRANSACTIONS,
    "datos_transaccionales_train_lite": TRANSACTIONS,
    "datos_transaccionales_predict": TRANSACTIONS,
    "datos_var_rpta_train": LABELS,
    "datos_var_rpta_train_lite": LABELS,
    "ids_predict": IDS_TO_SCORE,
    "maestro_cdgtrn_cdgrpta": CODE_DIMENSION,
}
