"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """Missing values are NULL inside the library; averages and maxima would pass NaN on."""
    return F.when(~F.isnan(value), value)


def floor_bin(value: Column, width: float | None) -> Column:
    """Lower edge of the bin of this width, downwards for negative values too."""
    return value if width is None else F.floor(value / F.lit(float(width))) * F.lit(int(width))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position of value between low and high; 0 where they are equal."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
