"""Distances and grid cells on the sphere."""

import math

from pyspark.sql import Column, functions as F

# Mean Earth radius used by the haversine formula.
EARTH_M = 6372800.0
EARTH_KM = 6372.8


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column,
              radius: float = EARTH_M) -> Column:
    """Great-circle distance of two points in degrees, in the unit of ``radius``."""
    # pow(x, 2) and not x * x: the latter would put the whole operand into the
    # generated code twice.
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / F.lit(2.0))
    half_lng = F.sin((F.radians(lng2) - F.radians(lng1)) / F.lit(2.0))
    a = F.pow(half_lat, 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        half_lng, 2.0)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def rms_distance(first: Column, second: Column) -> Column:
    """Root mean square of the two leg lengths of a two-place distance."""
    return F.sqrt((F.pow(first, 2.0) + F.pow(second, 2.0)) / F.lit(2.0))


def block_size(distance: float, radius: float = EARTH_M) -> float:
    """Angular cell width whose side is sqrt(2) times ``distance``."""
    return math.sqrt(2.0) * distance / radius


def cell_index(degrees: Column, width: float, truncate: bool = False) -> Column:
    """Grid index of one coordinate. ``truncate`` rounds toward zero, which
    makes the cells around zero twice as wide; floor is the regular grid."""
    ratio = F.radians(degrees) / F.lit(width)
    return (ratio if truncate else F.floor(ratio)).cast("bigint")
