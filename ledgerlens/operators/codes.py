"""The code dimension and the features that need it.

A dimension key with several rows multiplies the transactions it matches. The
dimension is therefore reduced to one row per key that carries how many rows of
each kind it had; joining and summing those weights equals joining the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.entropy import entropy10
from ledgerlens.functions.naming import column_suffix
from ledgerlens.functions.timeparts import count_if, share
from ledgerlens.session import materialize

KEYS = ("canal", "disposit", "cdgtrn", "cdgrpta")
GENERATED = {"ratio_dg_": "descripcion_grupo", "ratio_pa_": "producto_asociado"}
CLASS_RATIOS = ("ratio_financiera", "ratio_exitosa", "ratio_no_exitosa")

BROADCAST_BYTES = 64 << 20
JOIN_SALTS = 64


def _code_to_int(code: Column) -> Column:
    text = code.cast("string")
    text = F.when(text == "None", F.lit("-1")).otherwise(text)
    return F.round(text.cast("decimal(38,18)"), 0).cast("int")


def clean_codes(raw: DataFrame) -> DataFrame:
    """Text codes to integers: 'None' is -1, halves round away from zero.

    Codes that are integers already stay as they are.
    """
    return raw.withColumns({c: _code_to_int(F.col(c)) for c in ("cdgtrn", "cdgrpta")})


def duplicate_keys(dimension: DataFrame) -> DataFrame:
    """Dimension keys that occur more than once, with their count."""
    return dimension.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")


def _labelled_values(dimension: DataFrame) -> DataFrame:
    pairs = [
        F.struct(F.lit(prefix).alias("prefix"), F.col(column).alias("value"))
        for prefix, column in GENERATED.items()
    ]
    return dimension.select(*KEYS, F.inline(F.array(*pairs)))


def dimension_values(dimension: DataFrame) -> DataFrame:
    """Distinct group and product names with the column made from each."""
    values = _labelled_values(dimension).where(F.col("value").isNotNull())
    name = F.concat("prefix", column_suffix(F.col("value")))
    return values.select("prefix", "value").distinct().withColumn("column_name", name)


@dataclass(frozen=True)
class CodeTable:
    """The dimension made ready to join: one row of weights per key."""

    weights: DataFrame
    generated: list[str]
    broadcastable: bool

    @property
    def weight_columns(self) -> list[str]:
        return [c for c in self.weights.columns if c not in KEYS]


def _check_names(rows) -> None:
    seen = set()
    for row in rows:
        if row.column_name in seen:
            raise ValueError(f"two dimension values give the column {row.column_name}")
        seen.add(row.column_name)


def code_table(dimension: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> CodeTable:
    """Look up the generated columns and the size of the dimension in one small job.

    One column for each group and product is wanted, so their names are collected; see
    ``group_shares_long`` for dimensions too wide for columns. The weights are written once
    and every use reads the table.
    """
    dimension = materialize(dimension, "dimension")
    key_bytes = F.octet_length("canal") + F.octet_length("disposit")
    name = F.concat("prefix", column_suffix(F.col("value")))
    found = (
        _labelled_values(dimension)
        .groupBy("prefix", "value")
        .agg(F.count("*").alias("n"), F.sum(key_bytes).alias("bytes"))
        .withColumn("column_name", name)
        .collect()
    )
    named = sorted((r for r in found if r.value is not None), key=lambda r: r.column_name)
    _check_names(named)

    flags = {
        "w_financiera": F.col("clasif_trxn") == "Financiera",
        "w_exitosa": F.col("clasif_cod_rpta") == "Exitosa",
        "w_no_exitosa": F.col("clasif_cod_rpta") == "No Exitosa",
        "w_culpa": F.col("culpa_banco") == "SI",
    }
    for row in named:
        flags["w_" + row.column_name] = F.col(GENERATED[row.prefix]) == F.lit(row.value)
    weights = dimension.dropna(subset=list(KEYS)).groupBy(*KEYS).agg(
        F.count("*").alias("w_rows"), *[count_if(f).alias(k) for k, f in flags.items()]
    )

    # One prefix sees every dimension row once; a key has at most that many rows.
    first = next(iter(GENERATED))
    rows = sum(r.n for r in found if r.prefix == first)
    text = sum(r.bytes or 0 for r in found if r.prefix == first)
    size = rows * 8 * (len(weights.columns) + len(KEYS)) + text
    generated = [r.column_name for r in named]
    return CodeTable(materialize(weights, "codes"), generated, size <= broadcast_bytes)


def match_codes(trxn: DataFrame, table: CodeTable) -> DataFrame:
    """Sums of weights over the matched transactions of each id.

    A dimension of a checked size is broadcast. A larger one is joined by
    shuffle after counting equal transactions, spread by a salt because a few
    code combinations cover most rows.
    """
    if table.broadcastable:
        matched = trxn.join(F.broadcast(table.weights), list(KEYS), "inner")
        sums = [F.sum(c).alias(c) for c in table.weight_columns]
        return matched.groupBy("id").agg(*sums)
    salts = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))
    counted = (
        trxn.dropna(subset=list(KEYS))
        .groupBy("id", *KEYS)
        .agg(F.count("*").alias("n"))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(JOIN_SALTS)).cast("int"))
    )
    matched = counted.join(table.weights.withColumn("salt", salts), [*KEYS, "salt"], "inner")
    sums = [F.sum(F.col("n") * F.col(c)).alias(c) for c in table.weight_columns]
    return matched.groupBy("id").agg(*sums)


def class_ratio_columns() -> list[Column]:
    parts = ("w_financiera", "w_exitosa", "w_no_exitosa")
    return [share(F.col(w), F.col("w_rows")).alias(c) for w, c in zip(parts, CLASS_RATIOS)]


def fault_entropy_column() -> Column:
    fault, rows = F.col("w_culpa"), F.col("w_rows")
    return entropy10([fault, rows - fault], rows).alias("culpabanco_entropy")


def generated_columns(table: CodeTable, fraction: bool = False) -> list[Column]:
    """One column per group and product.

    By default whole-number division: 1 only if every matched row is of the
    value. ``fraction=True`` gives the share instead.
    """
    rows = F.col("w_rows")
    columns = []
    for name in table.generated:
        part = F.col("w_" + name)
        if fraction:
            columns.append(share(part, rows).alias(name))
        else:
            flag = F.when(rows.isNotNull(), (part == rows).cast("bigint"))
            columns.append(flag.alias(name))
    return columns


def class_ratios(trxn: DataFrame, table: CodeTable) -> DataFrame:
    """Shares of financial, successful and failed rows among the matched ones."""
    return match_codes(trxn, table).select("id", *class_ratio_columns())


def fault_entropy(trxn: DataFrame, table: CodeTable) -> DataFrame:
    """Entropy of bank-at-fault against everything else over the matched rows."""
    return match_codes(trxn, table).select("id", fault_entropy_column())


def group_flags(trxn: DataFrame, table: CodeTable, fraction: bool = False) -> DataFrame:
    """One column per group and product name; see :func:`generated_columns`."""
    return match_codes(trxn, table).select("id", *generated_columns(table, fraction))


def group_shares_long(trxn: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows (id, column_name, n, rows) in place of generated columns, however many there are.

    ``n`` of the ``rows`` matched rows of the id have the value that gives the column.
    Equal transactions are counted first and spread by a salt; nothing is collected.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))
    counted = trxn.dropna(subset=list(KEYS)).groupBy("id", *KEYS).agg(F.count("*").alias("n")).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(JOIN_SALTS)).cast("int"))
    name = F.concat("prefix", column_suffix(F.col("value"))).alias("column_name")
    values = _labelled_values(dimension.dropna(subset=list(KEYS))).groupBy(*KEYS, name).agg(
        F.count("*").alias("w"))
    matched = counted.join(values.withColumn("salt", salts), [*KEYS, "salt"])
    summed = matched.groupBy("id", "column_name").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    rows = dimension.dropna(subset=list(KEYS)).groupBy(*KEYS).agg(F.count("*").alias("w"))
    totals = counted.join(rows.withColumn("salt", salts), [*KEYS, "salt"]).groupBy("id").agg(
        F.sum(F.col("n") * F.col("w")).alias("rows"))
    return summed.where(F.col("column_name").isNotNull()).join(totals, "id").select(
        "id", "column_name", "n", "rows")
