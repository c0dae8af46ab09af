"""Random numbers that follow from a seed and names, the same in every engine and on every run."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, functions as F

DRAW_DIGITS = 13
DRAW_STEPS = float(16 ** DRAW_DIGITS)


def draw(*names: Column) -> Column:
    """Uniform in [0, 1), in steps of 2**-52."""
    digits = F.substring(F.md5(F.concat_ws(":", *[n.cast("string") for n in names])), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(DRAW_STEPS)


def drawn(*names: object) -> float:
    """The same number in Python."""
    return int(md5(":".join(map(str, names)).encode()).hexdigest()[:DRAW_DIGITS], 16) / DRAW_STEPS
