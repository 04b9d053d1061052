"""Spherical geometry as column expressions (unit sphere, degrees in and out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, safe_div

EARTH_RADIUS_KM = 6371.0


def lonlat_to_xyz(lon: str | Column, lat: str | Column) -> tuple[Column, Column, Column]:
    lam, phi = F.radians(col(lon)), F.radians(col(lat))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def wrap_lon(lon: str | Column) -> Column:
    """Longitude in (-180, 180]."""
    lon = F.pmod(col(lon), F.lit(360.0))
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def xyz_to_lonlat(x: str | Column, y: str | Column, z: str | Column) -> tuple[Column, Column]:
    lat = F.degrees(F.asin(col(z)))
    return wrap_lon(F.degrees(F.atan2(col(y), col(x)))), lat


def chord(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Straight-line distance between two points."""
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def cell_area(lat0: str | Column, lat1: str | Column, lon0: str | Column, lon1: str | Column) -> Column:
    """Area of a latitude-longitude cell."""
    height = F.sin(F.radians(col(lat1))) - F.sin(F.radians(col(lat0)))
    return height * F.radians(col(lon1) - col(lon0))


def resolution_km(npix: Column, height: Column | float = 1.0) -> Column:
    """Mean node spacing of ``npix`` nodes on a zone of the given half height."""
    h = height if isinstance(height, Column) else F.lit(float(height))
    zone = 2 * h * EARTH_RADIUS_KM
    return F.sqrt(safe_div(F.lit(2 * 3.141592653589793 * EARTH_RADIUS_KM) * zone, npix.cast("double")))
