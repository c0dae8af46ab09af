"""The columns of a dimension of any width as entries: id, column, value; zeros are not stored.

One column for each group and product needs their names on the driver. Entries do not: they are counted,
scaled, compared with the label, selected and packed into sparse vectors by joins and groupings, so the
width may grow with the data. Only the columns that a model is trained on are given places.
"""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.codes import group_shares_long
from ledgerlens.operators.ranking import running_sums
from ledgerlens.operators.sampling import LABEL
from ledgerlens.session import Scratch, materialize


def group_entries(trxn: DataFrame, dimension: DataFrame, fraction: bool = False) -> DataFrame:
    """``id``, ``feature``, ``value`` of the generated columns that are not zero.

    As in the dense columns, 1 if every matched row of the id is of the value; ``fraction=True`` gives the share.
    """
    counted = group_shares_long(trxn, dimension).where(F.col("id").isNotNull())
    value = F.col("n") / F.col("rows") if fraction else (F.col("n") == F.col("rows")).cast("double")
    return counted.select("id", F.col("column_name").alias("feature"), value.alias("value")).where("value <> 0")


def entry_statistics(entries: DataFrame, rows: int) -> DataFrame:
    """``feature``, ``mean`` and population ``deviation`` over ``rows`` ids, those without an entry counting as 0."""
    n = F.lit(float(rows))
    least = F.least(F.min("value"), F.when(F.count("*") < rows, F.lit(0.0)))
    most = F.greatest(F.max("value"), F.when(F.count("*") < rows, F.lit(0.0)))
    mean = F.sum("value") / n
    spread = F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0)))
    return entries.groupBy("feature").agg(
        mean.alias("mean"), F.when(least < most, spread).otherwise(0.0).alias("deviation"))


def scaled_entries(entries: DataFrame, statistics: DataFrame) -> DataFrame:
    """Values by their deviation; ``offset`` is what a missing entry of the feature would be.

    A scaled dense value is ``value + offset``. Constant features have no entry.
    """
    joined = entries.join(statistics.where("deviation > 0"), "feature")
    return joined.select("id", "feature", (F.col("value") / F.col("deviation")).alias("value"),
                         (-F.col("mean") / F.col("deviation")).alias("offset"))


def entry_correlations(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (feature, corr, n, mean_abs_corr) like those of the dense columns, over the ids of ``labels``.

    Features that do not vary there have no correlation; those without an entry are not listed.
    """
    y = F.col(LABEL).cast("double")
    whole = labels.agg(F.count("*").alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy"))
    v = F.col("value")
    sums = entries.join(labels.select("id", LABEL), "id").groupBy("feature").agg(
        F.sum(v).alias("sum_v"), F.sum(v * v).alias("sum_vv"), F.sum(v * y).alias("sum_vy"),
        F.count("*").alias("stored"), F.min("value").alias("least"), F.max("value").alias("most"))
    # One row.
    joined = sums.join(F.broadcast(whole))
    n = F.col("n").cast("double")
    product = n * F.col("sum_vy") - F.col("sum_v") * F.col("sum_y")
    spread = F.sqrt((n * F.col("sum_vv") - F.col("sum_v") * F.col("sum_v")) * (n * F.col("sum_yy") - F.col("sum_y") * F.col("sum_y")))
    varies = (F.col("stored") < F.col("n")) | (F.col("least") < F.col("most"))
    rated = joined.select("feature", F.when(varies, F.try_divide(product, spread)).alias("corr"), "n")
    mean = rated.agg(F.avg(F.abs("corr")).alias("mean_abs_corr"))
    return rated.join(F.broadcast(mean))


def sparse_vectors(entries: DataFrame, chosen: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, features) for training, and the places (feature, position) of the chosen features.

    Every id of ``labels`` has a row. ``chosen`` are rows (feature); their order is that of the names.
    """
    with Scratch(entries.sparkSession) as scratch:
        one = chosen.select("feature", F.lit(1).cast("long").alias("one")).distinct()
        places = materialize(running_sums(scratch, one, [], ["feature"], ["one"]).select(
            "feature", F.col("before_one").cast("int").alias("position")), "places")
    width = places.count()

    @F.udf(VectorUDT())
    def vector(held):
        held = held or []
        return SparseVector(width, [e.position for e in held], [e.value for e in held])

    packed = entries.join(places, "feature").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("position", "value"))).alias("held"))
    rows = labels.select("id", F.col(LABEL).cast("double").alias("label")).join(packed, "id", "left")
    return rows.select("id", "label", vector("held").alias("features")), places
