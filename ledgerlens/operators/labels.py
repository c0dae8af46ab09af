"""The label table, or the list of ids to score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def label_base(labels: DataFrame) -> DataFrame:
    """Label columns plus the year of the analysis month; ``var_rpta`` if there is one."""
    optional = ["var_rpta"] if "var_rpta" in labels.columns else []
    year = F.substring(F.col("f_analisis").cast("string"), 1, 4).cast("int")
    return labels.select("id", "f_analisis", "segmento", *optional, year.alias("year_analisis"))


def unique_labels(labels: DataFrame) -> DataFrame:
    """:func:`label_base` by id; the job fails if an id has two rows.

    The check is part of the grouping, so it costs no pass of its own.
    """
    base = label_base(labels)
    names = [c for c in base.columns if c != "id"]
    grouped = base.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.count("*").alias("n"), *[F.max(c).alias(c) for c in names]
    )
    twice = F.raise_error(F.concat(F.lit("label table has more than one row for id "), F.col("id")))
    return grouped.select(
        "id", *[F.when(F.col("n") > 1, twice).otherwise(F.col(c)).alias(c) for c in names]
    )
