"""Rounding that matches numpy / pandas ``round(d)``.

numpy rounds half-to-even on the scaled value: ``rint(x * 10**d) / 10**d``.
Spark's ``round`` (HALF_UP on the decimal expansion) and ``bround`` differ on
values such as 2.675, so every engineered value uses this form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    scale = 10 ** digits
    return F.rint(x * scale) / scale


def r6(x: Column) -> Column:
    """Six-digit rounding used on reported metrics so engines compare equal."""
    return half_even(x, 6)
