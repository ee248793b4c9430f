"""Column functions of the detectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres between points in degrees."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """``haversine_km`` for a pair of captured events."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, a)))


def per_hour(amount: Column, elapsed_ms: Column) -> Column:
    """A rate by the hour; out-of-order pairs count as one millisecond apart."""
    return amount / (F.greatest(elapsed_ms, F.lit(1)) / F.lit(3.6e6))


def in_band(x: Column, low: float, high: float) -> Column:
    return (x >= low) & (x < high)


def risk_score(declines: Column, max_amount: Column, high_amount: float = 400.0) -> Column:
    """25 for each of up to four declines, 15 for a high amount, at most 100."""
    return F.least(F.lit(100), 25 * F.least(declines, F.lit(4)) + F.when(max_amount >= high_amount, 15).otherwise(0)).cast("long")


def two_decimals(x: Column) -> Column:
    """A number to two decimals as C's printf gives it: the exact binary value is rounded, ties to even. (Spark's own
    formatting rounds the shortest decimal text half up.) Numbers of 10^15 and more have Spark's."""
    whole = F.floor(F.abs(x))
    rest = (F.abs(x) - whole) * F.lit(float(1 << 52))  # exact; below 1 it has a fraction of its own
    more = (rest - F.floor(rest)) * 100
    scaled = F.floor(rest) * 100 + F.floor(more)
    cents, left = F.shiftright(scaled, 52), scaled.bitwiseAND(F.lit((1 << 52) - 1))
    up = (left > 1 << 51) | (left == 1 << 51) & ((more > F.floor(more)) | (cents % 2 == 1))
    total = whole * 100 + cents + up.cast("long")
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    return F.when(F.abs(x) < 1e15, text).otherwise(F.format_string("%.2f", x))
