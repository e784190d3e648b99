"""Angles, speeds, radar units, grid arithmetic: plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of a degree for each unit of speed, and the rain-rate law.
DEGREE = {"km/h": 111.32, "m/s": 111320.0, "mp/h": 69.17}
MARSHALL_PALMER = (200.0, 1.6)
EARTH_A, EARTH_E = 6378137.0, 0.0818191908426215  # semi-major axis, eccentricity


def angle(u: Column, v: Column) -> Column:
    """Degrees in [0, 360) counter-clockwise from east."""
    a = F.degrees(F.atan2(v, u))
    return F.when(a < 0, a + 360).otherwise(a)


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def polar_to_uv(a: Column, m: Column) -> tuple[Column, Column]:
    return m * F.cos(F.radians(a)), m * F.sin(F.radians(a))


def point_position(x: Column, y: Column, a: Column, m: Column) -> tuple[Column, Column]:
    du, dv = polar_to_uv(a, m)
    return x + du, y + dv


def velocity(degrees: Column, minutes: float, unit: str) -> Column:
    """Speed of a displacement in degrees; ValueError for an unknown unit."""
    if unit not in DEGREE:
        raise ValueError(f"unit must be one of {sorted(DEGREE)}")
    return degrees * DEGREE[unit] / (minutes * 60.0 if unit == "m/s" else minutes / 60.0)


def velocity_from_pixels(cells: Column, pixel_area_km2: float, minutes: float, unit: str) -> Column:
    """Speed of a displacement in cells of the given area."""
    km = cells * math.sqrt(pixel_area_km2)
    return {"km/h": km / (minutes / 60.0), "m/s": km * 1000.0 / (minutes * 60.0), "mp/h": km * 0.621371 / (minutes / 60.0)}[unit]


def dbz_to_z(dbz: Column) -> Column:
    return F.pow(F.lit(10.0), dbz / 10.0)


def z_to_dbz(z: Column) -> Column:
    return 10.0 * F.log10(z)


def dbz_to_rain(dbz: Column) -> Column:
    a, b = MARSHALL_PALMER
    return F.pow(dbz_to_z(dbz) / a, F.lit(1.0 / b))


def rain_to_dbz(rain: Column) -> Column:
    a, b = MARSHALL_PALMER
    return z_to_dbz(a * F.pow(rain, F.lit(b)))


def cell_to_map(i: Column, origin: float, res: float) -> Column:
    return i * res + origin


def map_to_cell(p: Column, origin: float, res: float) -> Column:
    return F.floor((p - origin) / res)


def equal_area_km2(lat_low: Column, lat_high: Column, lon_width: float) -> Column:
    """Area between two parallels on the ellipsoid, over ``lon_width`` degrees."""

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        es = EARTH_E * s
        return (1 - EARTH_E**2) * (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * EARTH_E))

    return math.radians(lon_width) * EARTH_A**2 / 2 * (q(lat_high) - q(lat_low)) / 1e6


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def map_zoom(lon_span: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.log2(360.0 / lon_span))).cast("int")


def chaikin(points: Column) -> Column:
    """One round of corner cutting on ``array<struct<x, y>>``; ends stay."""
    n = F.size(points)
    mix = lambda p, q, w: F.struct((p["x"] * (1 - w) + q["x"] * w).alias("x"), (p["y"] * (1 - w) + q["y"] * w).alias("y"))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(mix(F.element_at(points, i), F.element_at(points, i + 1), 0.25), mix(F.element_at(points, i), F.element_at(points, i + 1), 0.75))))
    return F.when(n < 3, points).otherwise(F.concat(F.slice(points, 1, 1), cut, F.slice(points, -1, 1)))
