"""Class balance, positional split and folds; the row order is that of ``id``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.ranking import KeyRanks, at_most, shuffled_positions

LABEL = "var_rpta"


def labelled(df: DataFrame) -> DataFrame:
    """All rows of a class."""
    return df.where(F.col(LABEL).isNotNull())


def class_counts(df: DataFrame) -> dict[int, int]:
    """Rows per class; rows without a label are in no class."""
    return dict(sorted(labelled(df).groupBy(LABEL).count().collect()))


def cut_ids(ranks: KeyRanks, groups: Mapping[tuple, Iterable[int]]) -> dict[tuple[tuple, int], int | None]:
    """The id of the ``n``-th row of each group for every ``n`` wanted; None beyond its last row."""
    return ranks.at([(group, n) for group, sizes in groups.items() for n in sizes])


def first_rows(by: Sequence[str], cuts: Mapping[tuple[tuple, int], int | None]) -> Column:
    """Whether a row is among the first ``n`` of its group, for one (group, n) of each group."""
    chosen = F.lit(False)
    for (group, n), cut in cuts.items():
        if n >= 1:
            inside = at_most("id", cut, everything=True)
            for column, value in zip(by, group):
                inside &= F.col(column) == value
            chosen |= inside
    return chosen


def balance_classes(
    df: DataFrame, max_ones: int | None = None, balance_factor: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """First ``max_ones`` ones and ``max_ones * balance_factor`` zeros.

    Without ``max_ones`` it is the smaller class times the factor, which then
    counts twice for the zeros. ``by`` balances each group on its own, all of them together.
    """
    keys = [*by, LABEL]
    rows = labelled(df)
    ranks = KeyRanks(rows, "id", keys)
    wanted = {}
    for group in {g[:-1] for g in ranks.counts}:
        ones = max_ones or int(min(n for g, n in ranks.counts.items() if g[:-1] == group) * balance_factor)
        wanted |= {(*group, 0): [int(ones * balance_factor)], (*group, 1): [ones]}
    return rows.where(first_rows(keys, cut_ids(ranks, wanted)))


def positional_split(df: DataFrame, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first ``fraction`` of the rows and the rest, counting unlabelled rows too."""
    ranks = KeyRanks(df, "id")
    n = int(ranks.counts.get((), 0) * fraction)
    first = at_most("id", ranks.at([((), n)])[(), n], everything=False)
    return df.where(first), df.where(~first)


def stratified_folds(df: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """Add ``fold``: every fold holds each class in equal parts."""
    placed = shuffled_positions(df, "id", seed, df.count(), by=(LABEL,))
    return placed.withColumn("fold", (F.col("position") % folds).cast("int")).drop("position")
