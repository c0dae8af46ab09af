"""Standardization with the population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

GROUP_COLUMNS = 20


def varies(column: str) -> Column:
    """Aggregate: whether the column has two different values.

    Merging partial deviations of equal values need not give exactly 0.
    """
    return F.min(column) < F.max(column)


@dataclass(frozen=True)
class Scaler:
    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Scaler:
        """Mean and population deviation of all columns, one row back for each group of columns.

        A constant column has deviation 0; its computed one may be a rounding error. Groups
        of ``GROUP_COLUMNS`` keep the aggregation small enough to be compiled; each reads its
        own columns only, so together they read the matrix once.
        """
        means, deviations = {}, {}
        for begin in range(0, len(columns), GROUP_COLUMNS):
            group = columns[begin:begin + GROUP_COLUMNS]
            row = df.agg(*[
                x for i, c in enumerate(group) for x in (
                    F.avg(c).alias(f"mean_{i}"),
                    F.when(varies(c), F.stddev_pop(c)).otherwise(0.0).alias(f"dev_{i}"))
            ]).first()
            means |= {c: row[f"mean_{i}"] for i, c in enumerate(group)}
            deviations |= {c: row[f"dev_{i}"] for i, c in enumerate(group)}
        return cls(means, deviations)

    def _scaled(self, column: str) -> Column:
        deviation = self.deviations[column]
        if not deviation:
            return F.lit(0.0)
        return (F.col(column) - self.means[column]) / deviation

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns; a constant column becomes 0."""
        return df.withColumns({c: self._scaled(c) for c in self.means})
