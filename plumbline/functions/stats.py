"""Small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96  # fixed values
WIDE = 0.35


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval, clipped to [0, 1]; (0, 0) when there are no trials."""
    n_ = n.cast("double")
    p = k / n_
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = Z95 * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def ratio(k: Column, n: Column) -> Column:
    """NULL when nothing was counted: an empty group has no rate."""
    return F.when(n > 0, k / n)
