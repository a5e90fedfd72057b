"""Sums of doubles that do not depend on the order in which rows are added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holds doubles below 1e20 as they are written, with up to 18 decimals.
DECIMAL = "decimal(38,18)"


def steady_sum(value: Column) -> Column:
    """Sum of a column of doubles, the same however the rows are split over tasks.

    The values are added as decimals, which is exact, so groups of equal total compare as
    equal.  The decimal total counts where it lies within the rounding error that the plain
    sum of the doubles may have; the plain sum counts where it does not (values out of the
    range of the decimal, too small for its digits, or not finite).
    """
    plain = F.sum(value)
    exact = F.try_sum(value.try_cast(DECIMAL)).cast("double")
    error = F.sum(F.abs(value)) * F.count(value) * F.lit(2.0**-52)
    return F.when(F.abs(exact - plain) < error, exact).otherwise(plain)
