"""Column names that hold for tables with any columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots or backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names: Iterable[str]) -> list[Column]:
    return [column(name) for name in names]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it if ``df`` has such a column, in any case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
