"""Sky positions and magnitudes as Column expressions. Angles are degrees unless a name says arcsec."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# J2000 position of the north galactic pole, and the instrument's zero points.
POLE_RA, POLE_DEC = 192.85948, 27.12825
ZERO_JY_1, ZERO_JY_2 = 309.54, 171.787
JY_PER_DN_1, JY_PER_DN_2 = 1.54851985514e-6, 2.49224248693e-6
ZERO_MAG_DN = 20.752


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Right ascension in [0, 360) and declination of a vector of any length but 0."""
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def haversine_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    half_d, half_a = F.radians(dec2 - dec1) / 2, F.radians(ra2 - ra1) / 2
    h = F.sin(half_d) * F.sin(half_d) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.sin(half_a) * F.sin(half_a)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * 3600


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def galactic_latitude(ra: Column, dec: Column) -> Column:
    d, pole = F.radians(dec), math.radians(POLE_DEC)
    s = F.sin(d) * math.sin(pole) + F.cos(d) * math.cos(pole) * F.cos(F.radians(ra - POLE_RA))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def galactic_modifier(latitude: Column) -> Column:
    return F.greatest(F.lit(0.0), (10 - F.abs(latitude)) / 10)


def magnitude(flux: Column, zero: float) -> Column:
    """Null where the flux isn't positive."""
    return F.when(flux > 0, -2.5 * F.log10(flux / zero))


def magnitude_error(flux: Column, sigma: Column) -> Column:
    return F.when(flux > 0, sigma / flux * (2.5 / math.log(10)))


def absolute_magnitude(apparent: Column, parsec: Column) -> Column:
    return F.when(parsec > 0, apparent - 5 * (F.log10(parsec) - 1))


def spread_position(key: Column) -> tuple[Column, Column]:
    """A position for any number, spread over the sky by the golden angle (adapter for tables without positions)."""
    turn = key * F.lit(0.6180339887)
    return F.pmod(key * F.lit(137.50776405), F.lit(360.0)), F.degrees(F.asin(2 * (turn - F.floor(turn)) - 1))
