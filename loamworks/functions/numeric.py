"""Numeric expressions with defined rounding and bounds."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    """The value within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """``a`` / ``b``, or ``default`` where ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def level(score: Column) -> Column:
    """The band of a score from 0 to 100: 1 below 20, up to 5 from 80 on."""
    return F.least(F.greatest(F.floor(score / 20) + 1, F.lit(1)), F.lit(5)).cast("bigint")


def noisy_or(c: Column) -> Column:
    """Aggregate: the chance that at least one of independent signals of these confidences holds."""
    return 1 - F.product(1 - c)
