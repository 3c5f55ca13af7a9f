"""Cantons, regions, elevation classes and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firnline.vocabulary import (
    EARTH_RADIUS_KM, ELEVATION_BINS, HISTORY_REGIONS, LIVE_REGIONS, NO_REGION, REGION_IDS,
)


def _region(canton: Column, regions: dict[str, list[str]]) -> Column:
    case = F
    for name, cantons in regions.items():
        case = case.when(canton.isin(cantons), name)
    return case.otherwise(NO_REGION)


def alpine_region_live(canton: Column) -> Column:
    return _region(canton, LIVE_REGIONS)


def alpine_region_hist(canton: Column) -> Column:
    """Map used for the accident history; FL has no region there."""
    return _region(canton, HISTORY_REGIONS)


def region_id(region: Column) -> Column:
    case = F
    for name, number in REGION_IDS.items():
        case = case.when(region == name, number)
    return case.otherwise(0)


def elevation_group(elevation: Column) -> Column:
    """Right-closed classes; NULL outside (0, 5000]."""
    case = F
    for low, high, name in ELEVATION_BINS:
        case = case.when((elevation > low) & (elevation <= high), name)
    return case


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # clamp: rounding may lift antipodal points above 1
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
