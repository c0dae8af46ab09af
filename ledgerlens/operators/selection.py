"""Feature scores against the label, and the choice of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.sampling import LABEL, balance_classes
from ledgerlens.operators.scaling import Scaler, varies

SELECTION_ONES = 500
TOP_SCORES = 10
BLOCK_COLUMNS = 64


def _pearson(feature: str, label: str) -> Column:
    """Aggregate: correlation, NULL if one side is constant."""
    x, y = F.col(feature).cast("double"), F.col(label).cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(varies(feature) & varies(label), r)


def label_correlations(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Rows (feature, corr, n, mean_abs_corr) against the label, in one pass.

    ``n`` is the number of rows of ``df``; the mean is over the features that vary.
    """
    wide = df.agg(
        *[_pearson(c, label).alias(f"corr_{i}") for i, c in enumerate(features)],
        F.count("*").alias("n"),
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"corr_{i}").alias("corr"))
        for i, c in enumerate(features)
    ]
    strengths = F.array_compact(F.array(*[F.abs(f"corr_{i}") for i in range(len(features))]))
    total = F.aggregate(strengths, F.lit(0.0), lambda sum_, x: sum_ + x)
    mean = F.try_divide(total, F.size(strengths).cast("double")).alias("mean_abs_corr")
    return wide.select(F.inline(F.array(*rows)), "n", mean)


def correlation_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Absolute correlation of every column, the label itself included."""
    scored = label_correlations(df, [*features, LABEL])
    return scored.select("feature", F.abs("corr").alias("abs_corr"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature_a, feature_b, corr) for all pairs of columns that vary; the columns have no NULL.

    Every task multiplies its standardized rows, block of columns by block of columns, and the products
    of a pair of columns are summed up by grouping; the matrix never comes to the driver.
    """
    scaler = Scaler.fit(df, columns)
    kept = [c for c in columns if scaler.deviations[c]]
    if not kept:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    means = np.array([scaler.means[c] for c in kept])
    deviations = np.array([scaler.deviations[c] for c in kept])
    begins = range(0, len(kept), BLOCK_COLUMNS)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = {}, 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = (x - means) / deviations
            n += len(x)
            for a in begins:
                left = x[:, a:a + BLOCK_COLUMNS].T
                for b in begins[a // BLOCK_COLUMNS:]:
                    sums[a, b] = sums.get((a, b), 0.0) + left @ x[:, b:b + BLOCK_COLUMNS]
        for (a, b), block in sums.items():
            rows, places = np.indices(block.shape)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows.ravel() + a, pa.int32()), pa.array(places.ravel() + b, pa.int32()),
                pa.array(block.ravel()), pa.array(np.full(block.size, n), pa.int64())], ["a", "b", "product", "n"])

    vectors = df.select(F.array(*[F.col(c).cast("double") for c in kept]).alias("x"))
    summed = vectors.mapInArrow(products, "a int, b int, product double, n bigint").where("a <= b").groupBy("a", "b").agg(
        (F.sum("product") / F.sum("n")).alias("corr"))
    names = F.array(*[F.lit(c) for c in kept])
    one, other = F.get(names, F.col("a")), F.get(names, F.col("b"))
    pairs = F.array(F.struct(one.alias("feature_a"), other.alias("feature_b")), F.struct(other.alias("feature_a"), one.alias("feature_b")))
    # A column with itself is one pair.
    return summed.select(F.inline(F.slice(pairs, 1, F.when(F.col("a") == F.col("b"), 1).otherwise(2))), "corr")


def f_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """Univariate regression F of each feature; constant columns have none."""
    return f_scores_of(label_correlations(df, features))


def f_scores_of(scored: DataFrame) -> DataFrame:
    """F scores from rows (feature, corr, n)."""
    squared = F.col("corr") * F.col("corr")
    ratio = F.when(squared >= 1, F.lit(float("inf"))).otherwise(squared / (1 - squared))
    return scored.where(F.col("corr").isNotNull()).select("feature", (ratio * (F.col("n") - 2)).alias("f_score"))


def top_f_scores(df: DataFrame, features: list[str], k: int = TOP_SCORES) -> DataFrame:
    """The ``k`` highest F scores, ties by name."""
    return f_scores(df, features).orderBy(F.desc("f_score"), "feature").limit(k)


def corr_above_mean(df: DataFrame, features: list[str]) -> DataFrame:
    """Features whose absolute correlation is above the mean one."""
    return above_mean_of(label_correlations(df, features))


def above_mean_of(scored: DataFrame) -> DataFrame:
    strength = F.abs("corr").alias("abs_corr")
    return scored.where(F.abs("corr") > F.col("mean_abs_corr")).select("feature", strength)


def selected_features(sample: DataFrame, features: list[str]) -> DataFrame:
    """Union of the best F scores and the correlations above the mean."""
    return selected_of(label_correlations(sample, features))


def selected_of(scored: DataFrame, k: int = TOP_SCORES) -> DataFrame:
    """The same union from rows (feature, corr, n, mean_abs_corr)."""
    by_score = f_scores_of(scored).orderBy(F.desc("f_score"), "feature").limit(k).select("feature")
    return by_score.union(above_mean_of(scored).select("feature")).distinct()


def select_features(
    matrix: DataFrame, features: list[str], use_segment: bool = True, max_ones: int | None = SELECTION_ONES
) -> list[str]:
    """Names of the selected columns, sorted, from a balanced sample of the matrix.

    ``max_ones`` rows of each class are looked at; None takes as many as the smaller class has.
    """
    sample = balance_classes(matrix, max_ones=max_ones)
    names = {row.feature for row in selected_features(sample, features).collect()}
    if not use_segment:
        names.discard("segmento")
    return sorted(names)
