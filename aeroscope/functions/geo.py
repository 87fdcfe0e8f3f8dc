"""Flat-earth distance and enum coercion columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allowed texts of the enums.
PHASES = ("ground", "takeoff", "climb", "cruise", "descent", "approach", "landing", "taxi")
WAKES = ("L", "M", "H", "S")
RUNWAY_MODES = ("takeoff", "landing", "mixed", "closed")
OCCUPANTS = ("aircraft", "vehicle", "unknown")


def dist_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """60 NM per degree, longitude scaled at the FIRST point, so the distance is directed."""
    north = (lat2 - lat1) * 60
    east = (lon2 - lon1) * 60 * F.cos(F.radians(lat1))
    return F.sqrt(north * north + east * east)


def enum_or(value: Column, allowed: Sequence[str], default: str | None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
