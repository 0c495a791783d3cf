"""Locations as column expressions: shifts, distances, azimuths, earth-centred coordinates.

A location is latitude and longitude in degrees, east and north shifts in
metres, elevation up and depth down. Null inputs give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the mean radius used for shifts.
A = 6_378_137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
EARTH_M = 6_371_000.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def effective_lat(lat="lat", lon="lon", east="east_shift", north="north_shift") -> Column:
    """Latitude after moving by the shifts on a sphere; unchanged where both are 0."""
    lat, east, north = _c(lat), _c(east), _c(north)
    a = F.sqrt(east * east + north * north) / A
    az = F.atan2(east, north)
    moved = F.degrees(F.asin(F.sin(F.radians(lat)) * F.cos(a) + F.cos(F.radians(lat)) * F.sin(a) * F.cos(az)))
    return F.when((east == 0) & (north == 0), lat).otherwise(moved)


def effective_lon(lat="lat", lon="lon", east="east_shift", north="north_shift") -> Column:
    lat, lon, east, north = _c(lat), _c(lon), _c(east), _c(north)
    a = F.sqrt(east * east + north * north) / A
    az = F.atan2(east, north)
    la = F.radians(lat)
    dl = F.atan2(F.sin(az) * F.sin(a) * F.cos(la), F.cos(a) - F.sin(la) * (F.sin(la) * F.cos(a) + F.cos(la) * F.sin(a) * F.cos(az)))
    return F.when((east == 0) & (north == 0), lon).otherwise(lon + F.degrees(dl))


def effective_elevation(elevation="elevation", depth="depth") -> Column:
    return _c(elevation) - _c(depth)


def effective_depth(elevation="elevation", depth="depth") -> Column:
    return _c(depth) - _c(elevation)


def same_origin(lat1, lon1, lat2, lon2) -> Column:
    return (_c(lat1) == _c(lat2)) & (_c(lon1) == _c(lon2))


def sphere_distance(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance by the haversine form."""
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((p - q) / 2), 2.0) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon1) - _c(lon2)) / 2), 2.0)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ellipsoid_distance(lat1, lon1, lat2, lon2) -> Column:
    """Ellipsoidal surface distance to first order in the flattening (error below 50 m); 0 for equal points."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    f, g, l = F.radians((lat1 + lat2) / 2), F.radians((lat1 - lat2) / 2), F.radians((lon1 - lon2) / 2)  # noqa: E741
    s = F.pow(F.sin(g), 2.0) * F.pow(F.cos(l), 2.0) + F.pow(F.cos(f), 2.0) * F.pow(F.sin(l), 2.0)
    c = F.pow(F.cos(g), 2.0) * F.pow(F.cos(l), 2.0) + F.pow(F.sin(f), 2.0) * F.pow(F.sin(l), 2.0)
    w = F.atan2(F.sqrt(s), F.sqrt(c))
    r = F.try_divide(F.sqrt(s * c), w)
    d = 2 * w * A
    h1, h2 = F.try_divide(3 * r - 1, 2 * c), F.try_divide(3 * r + 1, 2 * s)
    out = d * (1 + FLATTENING * (h1 * F.pow(F.sin(f), 2.0) * F.pow(F.cos(g), 2.0) - h2 * F.pow(F.cos(f), 2.0) * F.pow(F.sin(g), 2.0)))
    return F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(out)


def planar_distance(e1, n1, e2, n2) -> Column:
    return F.sqrt(F.pow(_c(e1) - _c(e2), 2.0) + F.pow(_c(n1) - _c(n2), 2.0))


def surface_distance(a: dict, b: dict) -> Column:
    """a and b name the columns lat, lon, east, north: planar for the same origin, else ellipsoidal between effective points."""
    flat = planar_distance(a["east"], a["north"], b["east"], b["north"])
    ea = effective_lat(a["lat"], a["lon"], a["east"], a["north"]), effective_lon(a["lat"], a["lon"], a["east"], a["north"])
    eb = effective_lat(b["lat"], b["lon"], b["east"], b["north"]), effective_lon(b["lat"], b["lon"], b["east"], b["north"])
    return F.when(same_origin(a["lat"], a["lon"], b["lat"], b["lon"]), flat).otherwise(ellipsoid_distance(*ea, *eb))


def azimuth(de, dn) -> Column:
    """Degrees in (-180, 180] clockwise from north."""
    return F.degrees(F.atan2(_c(de), _c(dn)))


def sphere_azimuth(lat1, lon1, lat2, lon2) -> Column:
    p, q, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return F.degrees(F.atan2(F.sin(dl) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)))


def ecef(lat, lon, elevation) -> tuple[Column, Column, Column]:
    la, lo, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(elevation)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(la), 2.0))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - E2) + h) * F.sin(la)


def distance_3d(a: dict, b: dict) -> Column:
    """a and b name lat, lon, east, north, elevation, depth."""
    ea, eb = effective_elevation(a["elevation"], a["depth"]), effective_elevation(b["elevation"], b["depth"])
    flat = F.sqrt(F.pow(_c(a["east"]) - _c(b["east"]), 2.0) + F.pow(_c(a["north"]) - _c(b["north"]), 2.0) + F.pow(ea - eb, 2.0))
    ll = lambda x: (effective_lat(x["lat"], x["lon"], x["east"], x["north"]), effective_lon(x["lat"], x["lon"], x["east"], x["north"]))
    pa, pb = ecef(*ll(a), ea), ecef(*ll(b), eb)
    far = F.sqrt(sum((F.pow(x - y, 2.0) for x, y in zip(pa, pb)), F.lit(0.0)))
    return F.when(same_origin(a["lat"], a["lon"], b["lat"], b["lon"]), flat).otherwise(far)


def offset_from(lat0, lon0, lat, lon) -> tuple[Column, Column]:
    """(east, north) metres of a point from a reference on a sphere of the equatorial radius."""
    d, az = sphere_distance(lat0, lon0, lat, lon, A), F.radians(sphere_azimuth(lat0, lon0, lat, lon))
    return d * F.sin(az), d * F.cos(az)


def wkt(lat, lon, elevation) -> Column:
    return F.format_string("POINT Z(%.6f %.6f %.6f)", _c(lon), _c(lat), _c(elevation))


def location_hash(*columns: Column | str) -> Column:
    """sha1 over the location's numbers as text; null is a value of its own."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("~")) for c in columns]))


def jitter(c: Column | str, metres: float, seed: int) -> Column:
    """Uniform in +-metres/2, repeatable by seed."""
    return _c(c) + (F.rand(seed) - 0.5) * metres


def offset_3d(lat0, lon0, elevation0, lat, lon, elevation) -> tuple[Column, Column, Column]:
    """(east, north, down) metres of a point from a reference."""
    e, n = offset_from(lat0, lon0, lat, lon)
    return e, n, _c(elevation0) - _c(elevation)


def shifted(lat, lon, east, north, depth, by_east: float, by_north: float, by_depth: float = 0.0) -> tuple[Column, Column, Column, Column, Column]:
    """(lat, lon, east, north, depth) with shifts added; the origin stays."""
    return _c(lat), _c(lon), _c(east) + by_east, _c(north) + by_north, _c(depth) + by_depth


def origin(lat, lon) -> tuple[Column, Column, Column, Column]:
    """(lat, lon, east, north) of a location's origin: without its shifts."""
    return _c(lat), _c(lon), F.lit(0.0), F.lit(0.0)


def to_origin(lat, lon, east, north) -> tuple[Column, Column, Column, Column]:
    """(lat, lon, east, north) with the shifts worked into lat and lon."""
    return effective_lat(lat, lon, east, north), effective_lon(lat, lon, east, north), F.lit(0.0), F.lit(0.0)


def distance_without_elevation(surface: Column, depth) -> Column:
    """Hypocentral distance as older catalogues have it: the depth below zero alone."""
    return F.sqrt(F.pow(surface, 2.0) + F.pow(_c(depth), 2.0))
