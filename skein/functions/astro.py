"""Positions and velocities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# km/s per (mas/yr · kpc); the solar motion against the local
# standard of rest in km/s; the rotation from ICRS to Galactic axes (the
# published matrix of the Hipparcos convention).
KM_S_PER_MASYR_KPC = 4.74047
SOLAR_MOTION = (11.1, 12.24, 7.25)
ICRS_TO_GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def spherical_to_cartesian(l_deg: Column, b_deg: Column, distance: Column) -> tuple[Column, Column, Column]:
    l, b = F.radians(l_deg), F.radians(b_deg)
    return distance * F.cos(b) * F.cos(l), distance * F.cos(b) * F.sin(l), distance * F.sin(b)


def cartesian_to_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude in 0..360, latitude, distance; the origin gives latitude null."""
    d = F.sqrt(x * x + y * y + z * z)
    l = F.degrees(F.atan2(y, x))
    return F.when(l < 0, l + 360).otherwise(l), F.degrees(F.asin(z / F.nullif(d, F.lit(0.0)))), d


def solar_projection(l_deg: Column, b_deg: Column, motion: tuple[float, float, float] = SOLAR_MOTION) -> tuple[Column, Column]:
    """The solar motion's components along galactic longitude and latitude."""
    u, v, w = motion
    l, b = F.radians(l_deg), F.radians(b_deg)
    return -u * F.sin(l) + v * F.cos(l), -u * F.cos(l) * F.sin(b) - v * F.sin(l) * F.sin(b) + w * F.cos(b)


def proper_motion_velocity(pm: Column, distance_pc: Column) -> Column:
    """Tangential velocity in km/s of a proper motion in mas/yr; null without a positive finite distance."""
    good = (distance_pc > 0) & ~F.isnan(distance_pc) & (distance_pc < F.lit(float("inf"))) & ~F.isnan(pm) & (F.abs(pm) < F.lit(float("inf")))
    return F.when(good, KM_S_PER_MASYR_KPC * pm * distance_pc / 1000)


def rotate(matrix: tuple[tuple[float, ...], ...], x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(r[0] * x + r[1] * y + r[2] * z for r in matrix)


def icrs_to_galactic(ra_deg: Column, dec_deg: Column) -> tuple[Column, Column]:
    x, y, z = rotate(ICRS_TO_GALACTIC, *spherical_to_cartesian(ra_deg, dec_deg, F.lit(1.0)))
    l, b, _ = cartesian_to_spherical(x, y, z)
    return l, b


def proper_motion_to_galactic(ra_deg: Column, dec_deg: Column, pm_ra: Column, pm_dec: Column) -> tuple[Column, Column]:
    """Proper motion (``pm_ra`` with cos dec) along galactic longitude and latitude, by the angle between the poles."""
    ra, dec = F.radians(ra_deg), F.radians(dec_deg)
    px, py, pz = ICRS_TO_GALACTIC[2]
    pole_dec, pole_ra = math.asin(pz), math.atan2(py, px)
    c1 = math.sin(pole_dec) * F.cos(dec) - math.cos(pole_dec) * F.sin(dec) * F.cos(ra - pole_ra)
    c2 = math.cos(pole_dec) * F.sin(ra - pole_ra)
    size = F.nullif(F.sqrt(c1 * c1 + c2 * c2), F.lit(0.0))
    return (c1 * pm_ra + c2 * pm_dec) / size, (-c2 * pm_ra + c1 * pm_dec) / size
