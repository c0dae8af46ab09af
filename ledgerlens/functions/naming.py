"""Column names made from the text values of the code dimension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def column_suffix(value: Column) -> Column:
    """Lower-case, without ``/`` and ``#``; ``-``, ``.`` and blanks become ``_``."""
    text = F.lower(value)
    for found, new in (("/", ""), ("#", ""), ("  ", " ")):
        text = F.replace(text, F.lit(found), F.lit(new))
    return F.regexp_replace(text, r"(?U)[-.\s]", "_")
