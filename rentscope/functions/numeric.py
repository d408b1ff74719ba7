"""Rounding and ratio helpers shared by every mart."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """Round half away from zero on the decimal value of a double.

    Going through decimal(38,10) first removes last-bit noise of double sums
    (which differs with summation order) so the result does not depend on the
    partitioning; then rounds half up as the source SQL did (1.005 -> 1.01).
    """
    return F.round(_c(c).try_cast("decimal(38,10)"), digits).cast("double")


def safe_ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (G12; ANSI mode would raise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    """100 * num / den as double, NULL on a zero denominator."""
    return F.lit(100.0) * safe_ratio(num, den)
