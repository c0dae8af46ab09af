"""The given event and order tables seen as transactions, labels and dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import materialize
from ledgerlens.sources.tables import Inputs

_EVENTS = """
select user_id id, ts, event_type canal, value,
       cast(regexp_extract(props, '([0-9]+)', 1) as int) k,
       cast(unix_seconds(cast(ts as timestamp)) div 21600 - 78888 as int) sesion
from {events}
"""
_EVENT_TRANSACTIONS = """
select id, ts + make_dt_interval((sesion % 12) * 30) fecha_trxn, canal,
       concat('D', cast(k % 3 as string)) disposit, cast(k % 8 as int) cdgtrn,
       cast(k % 5 as int) cdgrpta, value vlrtran, sesion
from {ev}
"""
_EVENT_DIMENSION = """
select distinct canal, concat('D', cast(k % 3 as string)) disposit,
  cast(k % 8 as int) cdgtrn, cast(k % 5 as int) cdgrpta,
  case when k % 2 = 0 then 'Financiera' else 'Administrativa' end clasif_trxn,
  case when k % 5 = 0 then 'No Exitosa' when k % 5 = 4 then 'Parcial' else 'Exitosa' end clasif_cod_rpta,
  case when k % 7 = 0 then 'SI' when k % 7 = 1 then null else 'NO' end culpa_banco,
  case when k % 3 = 0 then 'Pagos / Recaudos' when k % 3 = 1 then 'Consultas #1' else 'Retiros' end descripcion_grupo,
  case when k = 1 then 'Credito' else 'Cuenta / Ahorros' end producto_asociado
from {ev} where k % 11 <> 0
"""
_LABELS = """
select c_custkey id, cast(201901 + c_custkey % 12 as int) f_analisis,
  cast(case when c_acctbal < 3000 then 1 else 0 end as int) var_rpta,
  cast(c_nationkey % 5 as int) segmento
from {customer} where c_custkey % 10 <> 9
"""
# The label follows the number of order lines, but for each tenth customer, where it is turned.
_LINE_LABELS = """
select c_custkey id, cast(201901 + c_custkey % 12 as int) f_analisis,
  cast(case when (coalesce(n, 0) >= 40) <> (c_custkey % 10 = 3) then 1 else 0 end as int) var_rpta,
  cast(c_nationkey % 5 as int) segmento
from {customer} left join (select id, count(*) n from {trxn} group by id) on id = c_custkey
where c_custkey % 10 <> 9
"""
_ORDER_TRANSACTIONS = """
select o_custkey id,
  l_shipdate + make_dt_interval(0, cast(l_partkey % 24 as int), cast(l_linenumber * 7 as int)) fecha_trxn,
  l_returnflag canal, l_linestatus disposit, cast(l_partkey % 8 as int) cdgtrn,
  cast(l_suppkey % 5 as int) cdgrpta, l_extendedprice vlrtran, cast(l_orderkey as int) sesion
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""
_ORDER_DIMENSION = """
select distinct canal, disposit, cdgtrn, cdgrpta,
  case when cdgtrn % 2 = 0 then 'Financiera' else 'Administrativa' end clasif_trxn,
  case when cdgrpta = 0 then 'No Exitosa' when cdgrpta = 4 then 'Parcial' else 'Exitosa' end clasif_cod_rpta,
  case when cdgtrn = 0 then 'SI' when cdgtrn = 1 then null else 'NO' end culpa_banco,
  case when cdgtrn < 3 then 'Pagos / Recaudos' when cdgtrn < 6 then 'Consultas #1' else 'Retiros' end descripcion_grupo,
  case when cdgtrn = 7 and cdgrpta = 3 then 'Credito' else 'Cuenta / Ahorros' end producto_asociado
from {trxn} where not (cdgtrn = 5 and cdgrpta = 2)
"""


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labels_from_customers(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Labels of the customers; each tenth has none unless the ``whole`` table is asked for."""
    rule = _LABELS.replace("where c_custkey % 10 <> 9", "") if whole else _LABELS
    return spark.sql(rule, customer=_table(spark, folder, "customer"))


def labels_from_lines(spark: SparkSession, folder: str, trxn: DataFrame) -> DataFrame:
    """Labels that the features of ``inputs_from_orders`` can tell, from its order lines ``trxn``."""
    return spark.sql(_LINE_LABELS, customer=_table(spark, folder, "customer"), trxn=trxn)


def whole_event_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension with every code combination of the events."""
    ev = spark.sql(_EVENTS, events=_table(spark, folder, "events"))
    return spark.sql(_EVENT_DIMENSION.replace("where k % 11 <> 0", ""), ev=ev)


def inputs_from_events(spark: SparkSession, folder: str, training: bool = True) -> Inputs:
    """Events as transactions, with six-hour sessions."""
    ev = spark.sql(_EVENTS, events=_table(spark, folder, "events"))
    labels = labels_from_customers(spark, folder)
    return Inputs(
        spark.sql(_EVENT_TRANSACTIONS, ev=ev),
        labels if training else labels.drop("var_rpta"),
        spark.sql(_EVENT_DIMENSION, ev=ev),
    )


def inputs_from_orders(
    spark: SparkSession, folder: str, training: bool = True, learnable: bool = False
) -> Inputs:
    """Order lines as transactions, an order being a session; ``learnable`` labels follow them.

    The join is written once, as every pass over the transactions, the dimension and the learnable labels read it.
    """
    trxn = materialize(spark.sql(
        _ORDER_TRANSACTIONS,
        lineitem=_table(spark, folder, "lineitem"),
        orders=_table(spark, folder, "orders"),
    ), "orders")
    labels = labels_from_lines(spark, folder, trxn) if learnable else labels_from_customers(spark, folder)
    return Inputs(
        trxn,
        labels if training else labels.drop("var_rpta"),
        spark.sql(_ORDER_DIMENSION, trxn=trxn),
    )
