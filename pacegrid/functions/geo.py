"""Geodesy and grid arithmetic as Column functions; distances in metres, angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Mean earth radius, metres per degree of latitude and of longitude at the
#: equator, metres per mile, default cell size.
EARTH_RADIUS = 6371008.8
LATITUDE_METRES, LONGITUDE_METRES = 110540.0, 111320.0
MILE, CELL = 1609.344, 200.0


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    up = F.sin(F.radians(lat_b - lat_a) / 2)
    across = F.sin(F.radians(lon_b - lon_a) / 2)
    h = up * up + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * across * across
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """(latitude, longitude) reached from a point on a great circle."""
    arc, phi, theta = metres / EARTH_RADIUS, F.radians(lat), F.radians(bearing)
    to = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta))
    turn = F.atan2(F.sin(theta) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(to))
    return F.degrees(to), lon + F.degrees(turn)


def cell_row(lat: Column, cell: float = CELL) -> Column:
    return F.floor(lat / F.lit(cell / LATITUDE_METRES)).cast("long")


def column_width(row: Column, cell: float = CELL) -> Column:
    """Degrees of longitude that a column of the row spans, at the row's centre latitude."""
    centre = (row + 0.5) * F.lit(cell / LATITUDE_METRES)
    return cell / (LONGITUDE_METRES * F.cos(F.radians(centre)))


def cell_column(lat: Column, lon: Column, cell: float = CELL) -> Column:
    return F.floor(lon / column_width(cell_row(lat, cell), cell)).cast("long")


def cell_id(lat: Column, lon: Column, cell: float = CELL) -> Column:
    return F.concat_ws(":", F.lit(int(cell)), cell_row(lat, cell), cell_column(lat, lon, cell))


def cell_centre(row: Column, column: Column, cell: float = CELL) -> tuple[Column, Column]:
    return (row + 0.5) * F.lit(cell / LATITUDE_METRES), (column + 0.5) * column_width(row, cell)
