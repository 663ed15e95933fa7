"""Positions on the globe as column expressions: distances, boxes, areas, map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
#: WGS 84: equatorial radius in metres and flattening.
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
METRES_PER_DEGREE = 111_320.0


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null if a coordinate is."""
    lat1, lon1, lat2, lon2 = map(_d, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).when(a < 0, 0.0).otherwise(a)))


def in_box(lon, lat, west, south, east, north) -> Column:
    """Whether a position lies in the box, edges included; a box with west > east crosses the antimeridian."""
    lon, lat, west, south, east, north = map(_d, (lon, lat, west, south, east, north))
    return lat.between(south, north) & F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))


def clipped(x: Column, low: Column, high: Column) -> Column:
    """``x`` moved into [low, high]; null stays null."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def rect_gap_km(lon, lat, west, south, east, north) -> Column:
    """Distance to the nearest point of a rectangle; 0 inside."""
    lon, lat, west, south, east, north = map(_d, (lon, lat, west, south, east, north))
    return haversine_km(lat, lon, clipped(lat, south, north), clipped(lon, west, east))


def _zone(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return s / (1 - E2 * s * s) + F.atanh(E * s) / E


def box_area_km2(west, south, east, north) -> Column:
    """Area on WGS 84 between two parallels and two meridians; west > east crosses the antimeridian."""
    west, south, east, north = map(_d, (west, south, east, north))
    width = F.when(west <= east, east - west).otherwise(east - west + 360)
    return F.lit(B * B / 2e6) * F.radians(width) * (_zone(north) - _zone(south))


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of the transverse Mercator series of Krueger, forward and back."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, back


def utm_zone(lon: Column) -> Column:
    """The zone's number, 1 to 60."""
    return (F.floor((_d(lon) + 180) / 6) % 60 + 1).cast("int")


def _false_northing(south: bool | Column) -> Column:
    return F.when(south if isinstance(south, Column) else F.lit(south), F.lit(10_000_000.0)).otherwise(F.lit(0.0))


def _sin_latitude(psi: Column, first: Column) -> Column:
    """The sine of the latitude whose isometric latitude is ``psi``."""
    sin_phi = first
    for _ in range(4):  # converges by a factor of E2 a turn
        sin_phi = F.tanh(psi + E * F.atanh(E * sin_phi))
    return sin_phi


def utm_forward(lon, lat, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Easting and northing in metres in the given UTM zone."""
    lon, lat = _d(lon), _d(lat)
    radius, forward, _ = _series()
    centre = (zone if isinstance(zone, Column) else F.lit(zone)).cast("double") * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - centre)
    t = F.sinh(F.atanh(F.sin(phi)) - E * F.atanh(E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(forward, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * x, _false_northing(south) + 0.9996 * radius * y


def utm_inverse(x, y, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Longitude and latitude of a position in the given UTM zone."""
    radius, _, back = _series()
    x, y = _d(x), _d(y)
    xi0, eta0 = (y - _false_northing(south)) / (0.9996 * radius), (x - 500_000) / (0.9996 * radius)
    xi, eta = xi0, eta0
    for j, c in enumerate(back, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    conformal = F.sin(xi) / F.cosh(eta)
    psi = F.atanh(conformal)
    sin_phi = _sin_latitude(psi, conformal)
    centre = (zone if isinstance(zone, Column) else F.lit(zone)).cast("double") * 6 - 183
    return centre + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(F.asin(sin_phi))


# Polar stereographic projections by EPSG code. Pole (1 north, -1 south), latitude of true scale in degrees or
# None with the scale at the pole, central meridian, false easting and northing in metres.
POLAR = {
    32661: (1, None, 0.994, 0.0, 2_000_000.0),
    5041: (1, None, 0.994, 0.0, 2_000_000.0),
    32761: (-1, None, 0.994, 0.0, 2_000_000.0),
    5042: (-1, None, 0.994, 0.0, 2_000_000.0),
    3413: (1, 70.0, None, -45.0, 0.0),
    3995: (1, 71.0, None, 0.0, 0.0),
    3031: (-1, 71.0, None, 0.0, 0.0),
}


def polar_scale(code: int) -> float:
    """Metres from the pole of a point whose ``exp(-isometric latitude)`` is 1."""
    _, true, at_pole, _, _ = POLAR[code]
    if true is None:
        return 2 * A * at_pole / math.sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E))
    sin_true = math.sin(math.radians(true))
    psi = math.atanh(sin_true) - E * math.atanh(E * sin_true)
    return A * math.cos(math.radians(true)) / math.sqrt(1 - E * E * sin_true * sin_true) * math.exp(psi)


def epsg_for(lon: Column, lat: Column) -> Column:
    """The code of a position's UTM zone on its hemisphere, or of the polar projection above 84 and below -80 degrees."""
    plain = F.when(_d(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)
    return F.when(_d(lat) > 84, F.lit(32661)).when(_d(lat) < -80, F.lit(32761)).otherwise(plain).cast("int")


def _by_code(epsg: Column, utm: Column, polar) -> Column:
    """``utm`` for the codes of UTM zones, ``polar(code)`` for those of :data:`POLAR`; other codes are an error."""
    zone = epsg % 100
    out = F.when(epsg.isNull(), F.lit(None).cast("double")).when((F.floor(epsg / 100).isin(326, 327)) & zone.between(1, 60), utm)
    for code in POLAR:
        out = out.when(epsg == code, polar(code))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown projection "), epsg.cast("string"))).cast("double"))


def projected(lon, lat, epsg: int | Column) -> tuple[Column, Column]:
    """Easting and northing in the projection ``epsg``, a code for all or each row's own: UTM of both hemispheres or one of
    :data:`POLAR`. A null code gives nulls, an unknown one is an error."""
    lon, lat = _d(lon), _d(lat)
    epsg = (epsg if isinstance(epsg, Column) else F.lit(epsg)).cast("int")
    x, y = utm_forward(lon, lat, epsg % 100, F.floor(epsg / 100) == 327)

    def place(code: int) -> tuple[Column, Column]:
        pole, _, _, meridian, false = POLAR[code]
        sin_phi, lam = pole * F.sin(F.radians(lat)), F.radians(lon - meridian)
        rho = F.when(sin_phi >= 1, F.lit(0.0)).otherwise(polar_scale(code) * F.exp(E * F.atanh(E * sin_phi) - F.atanh(sin_phi)))
        return false + rho * F.sin(lam), false - pole * rho * F.cos(lam)

    return _by_code(epsg, x, lambda code: place(code)[0]), _by_code(epsg, y, lambda code: place(code)[1])


def unprojected(x, y, epsg: int | Column) -> tuple[Column, Column]:
    """Longitude and latitude of a position in the projection ``epsg``, the inverse of :func:`projected`."""
    x, y = _d(x), _d(y)
    epsg = (epsg if isinstance(epsg, Column) else F.lit(epsg)).cast("int")
    lon, lat = utm_inverse(x, y, epsg % 100, F.floor(epsg / 100) == 327)

    def place(code: int) -> tuple[Column, Column]:
        pole, _, _, meridian, false = POLAR[code]
        east, up = x - false, -pole * (y - false)
        rho = F.hypot(east, up)
        psi = -F.ln(rho / polar_scale(code))
        turned = F.degrees(F.atan2(east, up)) + meridian
        away = F.when(turned > 180, turned - 360).when(turned <= -180, turned + 360).otherwise(turned)
        return away, F.when(rho == 0, F.lit(90.0 * pole)).otherwise(pole * F.degrees(F.asin(_sin_latitude(psi, F.tanh(psi)))))

    return _by_code(epsg, lon, lambda code: place(code)[0]), _by_code(epsg, lat, lambda code: place(code)[1])
