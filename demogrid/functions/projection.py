"""Map projections as column expressions: ellipsoidal Lambert azimuthal equal-area
(EPSG:3035) after Snyder 1987, section 24, and spherical Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# EPSG:3035 on GRS80, and the Web-Mercator sphere.
A = 6378137.0
INV_F = 298.257222101
LAT0, LON0 = 52.0, 10.0
FALSE_E, FALSE_N = 4321000.0, 3210000.0
R_MERC = 6378137.0

E2 = (2 - 1 / INV_F) / INV_F
ECC = math.sqrt(E2)


def _q_number(sin_phi: float) -> float:
    return (1 - E2) * (sin_phi / (1 - E2 * sin_phi ** 2)
                       - math.log((1 - ECC * sin_phi) / (1 + ECC * sin_phi)) / (2 * ECC))


QP = _q_number(1.0)
BETA1 = math.asin(_q_number(math.sin(math.radians(LAT0))) / QP)
RQ = A * math.sqrt(QP / 2)
M1 = math.cos(math.radians(LAT0)) / math.sqrt(1 - E2 * math.sin(math.radians(LAT0)) ** 2)
D = A * M1 / (RQ * math.cos(BETA1))
SIN_B1, COS_B1 = math.sin(BETA1), math.cos(BETA1)
# Series coefficients of the authalic-to-geodetic latitude (Snyder 3-18).
C2 = E2 / 3 + 31 * E2 ** 2 / 180 + 517 * E2 ** 3 / 5040
C4 = 23 * E2 ** 2 / 360 + 251 * E2 ** 3 / 3780
C6 = 761 * E2 ** 3 / 45360


def lonlat_to_laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres east / north."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s)
                    - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    beta = F.asin(q / QP)
    dlon = F.radians(lon - LON0)
    b = RQ * F.sqrt(2 / (1 + SIN_B1 * F.sin(beta) + COS_B1 * F.cos(beta) * F.cos(dlon)))
    e = FALSE_E + b * D * F.cos(beta) * F.sin(dlon)
    n = FALSE_N + b / D * (COS_B1 * F.sin(beta) - SIN_B1 * F.cos(beta) * F.cos(dlon))
    return e, n


def laea_to_lonlat(e: Column, n: Column) -> tuple[Column, Column]:
    """Metres east / north to degrees."""
    x, y = e - FALSE_E, n - FALSE_N
    rho = F.sqrt((x / D) * (x / D) + (D * y) * (D * y))
    ce = 2 * F.asin(rho / (2 * RQ))
    centre = rho < 1e-9
    sin_beta = F.cos(ce) * SIN_B1 + F.when(centre, F.lit(0.0)).otherwise(
        D * y * F.sin(ce) * COS_B1 / rho)
    beta = F.asin(sin_beta)
    lon = LON0 + F.when(centre, F.lit(0.0)).otherwise(F.degrees(F.atan2(
        x * F.sin(ce), D * rho * COS_B1 * F.cos(ce) - D * D * y * SIN_B1 * F.sin(ce))))
    lat = F.degrees(beta + C2 * F.sin(2 * beta) + C4 * F.sin(4 * beta) + C6 * F.sin(6 * beta))
    return lon, lat


def lon_to_mercator(lon: Column) -> Column:
    return F.radians(lon) * R_MERC


def lat_to_mercator(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * R_MERC


def mercator_to_lon(x: Column) -> Column:
    return F.degrees(x / R_MERC)


def mercator_to_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / R_MERC)) - math.pi / 2)


def wrap_longitude(lon: Column) -> Column:
    """Any longitude into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def unit_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Degrees to a point on the unit sphere; chords order like great-circle distances."""
    lam, phi = F.radians(lon), F.radians(lat)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def to_grid(x: Column, y: Column, srid: Column) -> tuple[Column, Column]:
    """Coordinates of EPSG:4326 (degrees), 3857 (Web Mercator) or 3035 (the grid's own) on the grid.

    Any other system stops the job: taken as it is, its features would match no cell."""
    degrees = srid == 4326
    lon = F.when(degrees, x).otherwise(mercator_to_lon(x))
    lat = F.when(degrees, y).otherwise(mercator_to_lat(y))
    e, n = lonlat_to_laea(lon, lat)
    known = F.when(srid.isin(4326, 3857), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unknown coordinate system "), F.coalesce(srid.cast("string"), F.lit("NULL")))).cast("boolean"))
    return F.when(srid == 3035, x).when(known, e), F.when(srid == 3035, y).when(known, n)
