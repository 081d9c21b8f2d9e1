"""Rounding of doubles as SQL does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(value: Column, digits: int) -> Column:
    """A double to so many places: its binary product with 10^digits to the nearest whole number, halves away from zero.

    F.round goes by the shortest decimal text instead and moves products such as 1.9 * 1.05 the other way.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale
