"""Base-10 entropy of the parts of a whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def entropy10(parts: Sequence[Column], whole: Column) -> Column:
    """``-sum(p * log10(p))`` for the shares ``p = part / whole``.

    An empty part adds 0; a NULL part, or a whole that is 0 or NULL, gives NULL.
    The parts need not add up to the whole.
    """
    n = whole.cast("double")
    terms = [F.when(part == 0, F.lit(0.0)).otherwise(part * F.log10(part / n)) for part in parts]
    return F.lit(0.0) - F.try_divide(reduce(add, terms), n)
