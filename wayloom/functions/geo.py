"""Coordinates, lines and tiles, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
# Metres per degree of the local plane, and the UTM zone 32 north ellipsoid and grid.
PER_LAT, PER_LAT_COS2, PER_LON = 111132.92, 559.82, 111412.84
AXIS, FLATTENING, SCALE, FALSE_EAST, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 9.0
_E2 = FLATTENING * (2 - FLATTENING)
_EP2 = _E2 / (1 - _E2)


def metres_per_degree(lat0: Column) -> tuple[Column, Column]:
    phi = F.radians(lat0)
    return F.lit(PER_LAT) - F.lit(PER_LAT_COS2) * F.cos(2 * phi), F.lit(PER_LON) * F.cos(phi)


def to_plane(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and south of the origin."""
    per_lat, per_lon = metres_per_degree(lat0)
    return (lon - lon0) * per_lon, (lat0 - lat) * per_lat


def from_plane(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    per_lat, per_lon = metres_per_degree(lat0)
    return lat0 - y / per_lat, lon0 + x / per_lon


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def tile(lat: Column, lon: Column, z: Column) -> tuple[Column, Column]:
    """Web-mercator tile that holds a coordinate, clamped to the map."""
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    top = (n - 1).cast("long")
    return F.greatest(F.lit(0), F.least(x, top)), F.greatest(F.lit(0), F.least(y, top))


def hilbert_id(z: str, x: str, y: str) -> Column:
    """Number of a tile: all tiles of lower zooms, then along the zoom's Hilbert curve."""
    return F.expr(
        f"""aggregate(if({z} > 0, reverse(sequence(0, cast({z} as int) - 1)), cast(array() as array<int>)),
            named_struct('x', cast({x} as long), 'y', cast({y} as long), 'd', 0L),
            (a, k) -> transform(array(named_struct('s', shiftleft(1L, k), 'rx', shiftright(a.x, k) & 1L, 'ry', shiftright(a.y, k) & 1L,
                                                   'x', a.x & (shiftleft(1L, k) - 1L), 'y', a.y & (shiftleft(1L, k) - 1L))), q -> named_struct(
                'x', case when q.ry = 1 then q.x when q.rx = 1 then q.s - 1L - q.y else q.y end,
                'y', case when q.ry = 1 then q.y when q.rx = 1 then q.s - 1L - q.x else q.x end,
                'd', a.d + q.s * q.s * ((3L * q.rx) ^ q.ry)))[0],
            a -> a.d) + (shiftleft(1L, 2 * cast({z} as int)) - 1L) div 3"""
    )


def to_utm32(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing (series in the longitude's distance from the meridian)."""
    phi, dl = F.radians(lat), F.radians(lon - MERIDIAN)
    n = AXIS / F.sqrt(1 - _E2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), _EP2 * F.pow(F.cos(phi), 2), F.cos(phi) * dl
    e4, e6 = _E2**2, _E2**3
    m = AXIS * (
        (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    east = FALSE_EAST + SCALE * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * F.pow(a, 5) / 120)
    north = SCALE * (
        m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * F.pow(a, 6) / 720)
    )
    return east, north


def from_utm32(east: Column, north: Column) -> tuple[Column, Column]:
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = north / SCALE / (AXIS * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    phi = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s2 = F.pow(F.sin(phi), 2)
    n, r = AXIS / F.sqrt(1 - _E2 * s2), AXIS * (1 - _E2) / F.pow(1 - _E2 * s2, 1.5)
    t, c, d = F.pow(F.tan(phi), 2), _EP2 * F.pow(F.cos(phi), 2), (east - FALSE_EAST) / (n * SCALE)
    lat = phi - n * F.tan(phi) / r * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) * F.pow(d, 6) / 720
    )
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(phi)
    return F.degrees(lat), F.lit(MERIDIAN) + F.degrees(lon)


def to_line(px: str, py: str, line: str) -> Column:
    """Distance from a point to a polyline, an array of structs x, y; null with fewer than two points."""
    step = to_segment_sql(px, py, f"{line}[i].x", f"{line}[i].y", f"{line}[i+1].x", f"{line}[i+1].y")
    return F.expr(f"if(size({line}) < 2, null, array_min(transform(sequence(0, greatest(size({line}) - 2, 0)), i -> {step})))")


def to_segment_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"greatest(0D, least(1D, coalesce((({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay})) / nullif(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}), 0D), 0D)))"
    return f"sqrt(pow({px}-({ax}+{t}*({bx}-{ax})),2)+pow({py}-({ay}+{t}*({by}-{ay})),2))"


def ring_area(ring: str) -> Column:
    """Signed area of a closed ring of structs x, y (shoelace)."""
    return F.expr(f"aggregate(sequence(0, size({ring}) - 2), 0D, (s, i) -> s + {ring}[i].x * {ring}[i+1].y - {ring}[i+1].x * {ring}[i].y) / 2")


def inside(px: str, py: str, ring: str) -> Column:
    """Whether a point is inside a closed ring (crossing number)."""
    return F.expr(
        f"""aggregate(sequence(0, size({ring}) - 2), false, (c, i) -> if(({ring}[i].y > {py}) <> ({ring}[i+1].y > {py})
            and {px} < ({ring}[i+1].x - {ring}[i].x) * ({py} - {ring}[i].y) / ({ring}[i+1].y - {ring}[i].y) + {ring}[i].x, not c, c))"""
    )


def climb(z: str, band: float) -> Column:
    """Ascent and descent (struct up, down) of heights with a dead band, then made whole end to end; 0 with a gap."""
    return F.expr(
        f"""if(size({z}) < 2 or exists({z}, v -> v is null), named_struct('up', 0D, 'down', 0D),
            aggregate(slice({z}, 2, size({z})), named_struct('last', {z}[0], 'up', 0D, 'down', 0D),
            (a, v) -> case when v > a.last + {band} then named_struct('last', v, 'up', a.up + (v - a.last), 'down', a.down)
                           when v < a.last - {band} then named_struct('last', v, 'up', a.up, 'down', a.down + (a.last - v)) else a end,
            a -> transform(array(element_at({z}, -1) - {z}[0] - (a.up - a.down)), d -> named_struct('up', a.up + greatest(d, 0D), 'down', a.down + greatest(-d, 0D)))[0]))"""
    )
