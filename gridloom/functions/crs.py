"""Coordinate systems: names to codes as Columns, projected metres to degrees in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
#: WGS84 flattening
FLATTENING = 1 / 298.257223563


def crs_code(crs: Column) -> Column:
    """EPSG code of a coordinate system in any usual spelling: NULL, CRS84 and "WGS 84" are degrees (4326), 900913 is
    3857, "WGS 84 / UTM zone 55N" is 32655. NULL if the text names no system known here."""
    c = F.upper(F.trim(crs))
    zone = F.regexp_extract(c, r"UTM ZONE (\d{1,2}) ?([NS])", 1).try_cast("int")
    south = F.regexp_extract(c, r"UTM ZONE (\d{1,2}) ?([NS])", 2) == "S"
    number = F.regexp_extract(c, r"(?:^|[^0-9])(\d{4,6})\s*$", 1).try_cast("int")
    return (
        F.when(crs.isNull() | (c == ""), F.lit(4326))
        .when(zone.isNotNull(), zone + F.when(south, 32700).otherwise(32600))
        .when(number.isin(3857, 900913, 3785, 102100), F.lit(3857))
        .when(number == 4326, F.lit(4326))
        .when(number.between(32601, 32660) | number.between(32701, 32760), number)
        .when(c.contains("CRS84") | c.isin("WGS 84", "WGS84"), F.lit(4326))
        .cast("int")
    )


def mercator_to_degrees(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(x / RADIUS), np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - np.pi / 2)


def utm_to_degrees(x: np.ndarray, y: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse transverse Mercator by the Krueger series of third order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi = (y - np.where(south, 10_000_000.0, 0.0)) / (0.9996 * a)
    eta = (x - 500_000.0) / (0.9996 * a)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    xi0, eta0 = xi.copy(), eta.copy()
    for j, b in enumerate(back, 1):
        xi0 -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        eta0 -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.clip(np.sin(xi0) / np.cosh(eta0), -1, 1))
    to_lat = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    lat = chi.copy()
    for j, d in enumerate(to_lat, 1):
        lat += d * np.sin(2 * j * chi)
    lon = np.degrees(np.arctan2(np.sinh(eta0), np.cos(xi0))) + zone * 6 - 183
    return lon, np.degrees(lat)


def degrees_to_utm(lon: np.ndarray, lat: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    e = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi0, eta0 = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    xi, eta = xi0.copy(), eta0.copy()
    for j, c in enumerate((n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240), 1):
        xi += c * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta += c * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    return 500_000.0 + 0.9996 * a * eta, np.where(south, 10_000_000.0, 0.0) + 0.9996 * a * xi


def to_degrees(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude in [-180, 180) and latitude; NaN where the code is unknown (0) or a coordinate is missing."""
    lon, lat = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    deg, mer, utm = code == 4326, code == 3857, (code > 32600) & (code <= 32760)
    lon[deg], lat[deg] = x[deg], y[deg]
    lon[mer], lat[mer] = mercator_to_degrees(x[mer], y[mer])
    lon[utm], lat[utm] = utm_to_degrees(x[utm], y[utm], code[utm] % 100, code[utm] > 32700)
    with np.errstate(invalid="ignore"):
        return (lon + 180.0) % 360.0 - 180.0, lat
