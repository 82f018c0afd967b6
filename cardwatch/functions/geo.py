"""Distances and positions on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; NULL when a coordinate is.

    Rounding can push the half chord of antipodal points above 1, where the arcsine is
    NaN: those are half a turn apart.  Each step appears once, so nothing is computed twice.
    """
    phi1, lam1, phi2, lam2 = (F.radians(c.cast("double")) for c in (lat1, lon1, lat2, lon2))
    across = F.pow(F.sin((phi2 - phi1) / 2.0), F.lit(2.0))
    along = F.cos(phi1) * F.cos(phi2) * F.pow(F.sin((lam2 - lam1) / 2.0), F.lit(2.0))
    return F.nanvl(F.asin(F.sqrt(across + along)), F.lit(math.pi / 2)) * (2.0 * EARTH_RADIUS_KM)


def staging_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The distance as the staging view stores it, to two decimals."""
    return haversine_km(lat1, lon1, lat2, lon2).cast("decimal(10,2)")


def latlon_to_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere."""
    phi, lam = F.radians(lat.cast("double")), F.radians(lon.cast("double"))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def geo_cell(lat: Column, lon: Column, degrees: float = 0.1) -> Column:
    """Name of an equal-angle grid cell (not a hexagon cell), e.g. `1157_827`."""
    row = F.floor((lat.cast("double") + 90.0) / degrees).cast("bigint")
    column = F.floor((lon.cast("double") + 180.0) / degrees).cast("bigint")
    return F.concat_ws("_", row, column)
