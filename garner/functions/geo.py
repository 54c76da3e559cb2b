"""Distances on the globe and how far a place may be named a venue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def venue_reach(accuracy: Column) -> Column:
    """Metres within which a place may be the venue: the fix' accuracy, at least 25."""
    return F.greatest(F.coalesce(accuracy, F.lit(0.0)), F.lit(25.0))
