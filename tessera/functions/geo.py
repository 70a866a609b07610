"""Column expressions on longitudes, latitudes, headings, rings and segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius and units, in metres.
EARTH_RADIUS = 6371008.0
NAUTICAL_MILE = 1852.0
FOOT = 0.3048
DEG_TO_MTR_LAT = EARTH_RADIUS * math.pi / 180
# The ellipsoid, in metres.
EQUATOR_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563


def dist_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance in metres, with the cosine of the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = lat2 - lat1
    return F.sqrt(dx * dx + dy * dy) * DEG_TO_MTR_LAT


def deg2mtr(lat: Column) -> Column:
    """Struct (lon_m, lat_m): metres per degree from the ellipsoid's principal radii."""
    e2 = FLATTENING * (2 - FLATTENING)
    s = F.sin(F.radians(lat))
    w = F.sqrt(1 - e2 * s * s)
    normal = EQUATOR_RADIUS / w
    meridian = EQUATOR_RADIUS * (1 - e2) / (w * w * w)
    return F.struct((F.radians(F.lit(1.0)) * normal * F.cos(F.radians(lat))).alias("lon_m"), (F.radians(F.lit(1.0)) * meridian).alias("lat_m"))


def heading_from_vector(lon: Column, lat: Column, dlon: Column, dlat: Column) -> Column:
    """Degrees from north of a vector in degrees, in [0, 360), corrected by the convergence of meridians."""
    return F.pmod(F.degrees(F.atan2(dlon * F.cos(F.radians(lat)), dlat)) - dlon * F.sin(F.radians(lat)), F.lit(360.0))


def ll_to_m(lon0: Column, lat0: Column, lon: Column, lat: Column) -> Column:
    """Struct (x, y): metres east and north of an origin."""
    return F.struct(((lon - lon0) * DEG_TO_MTR_LAT * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * DEG_TO_MTR_LAT).alias("y"))


def m_to_ll(lon0: Column, lat0: Column, x: Column, y: Column) -> Column:
    """Struct (lon, lat): the inverse of ``ll_to_m``."""
    return F.struct((lon0 + x / (DEG_TO_MTR_LAT * F.cos(F.radians(lat0)))).alias("lon"), (lat0 + y / DEG_TO_MTR_LAT).alias("lat"))


def runway_ends(lon: Column, lat: Column, heading: Column, length_m: Column) -> Column:
    """Struct (lon1, lat1, lon2, lat2): half the length behind and ahead of the centre."""
    half = length_m / 2
    dx, dy = half * F.sin(F.radians(heading)), half * F.cos(F.radians(heading))
    a, b = m_to_ll(lon, lat, -dx, -dy), m_to_ll(lon, lat, dx, dy)
    return F.struct(a["lon"].alias("lon1"), a["lat"].alias("lat1"), b["lon"].alias("lon2"), b["lat"].alias("lat2"))


def bbox_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (west, south, east, north) touch."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def ring_edges(ring: Column) -> Column:
    """Array of (a, b) for the closed ring."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed area of an array of (x, y), positive if counter-clockwise; 0 for fewer than three points."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_centroid(ring: Column) -> Column:
    """Struct (x, y); null for a ring without area."""
    twice = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    moment = lambda axis: F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][axis] + e["b"][axis]) * twice(e))
    six = F.nullif(6 * ring_area(ring), F.lit(0.0))
    return F.struct((moment("x") / six).alias("x"), (moment("y") / six).alias("y"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test: an edge counts if its span (x1, x2] or (x2, x1] holds x and the point is strictly above it."""

    def crossed(e: Column) -> Column:
        x1, y1, x2, y2 = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = ((x1 < x) & (x <= x2)) | ((x2 < x) & (x <= x1))
        return F.when(spans & (y > y1 + (y2 - y1) * (x - x1) / (x2 - x1)), 1).otherwise(0)

    return F.aggregate(ring_edges(ring), F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0)))))
    ox, oy = px - (x1 + t * dx), py - (y1 + t * dy)
    return ox * ox + oy * oy


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether the insides of two segments (x1, y1, x2, y2) cross; touching ends don't count."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    return (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)


def bezier_point(p1: Column, c1: Column, c2: Column, p2: Column, t: Column) -> Column:
    """One coordinate of a cubic Bézier at t."""
    u = 1 - t
    return u * u * u * p1 + 3 * u * u * t * c1 + 3 * u * t * t * c2 + t * t * t * p2


def round_by_parts(c: Column, n: int) -> Column:
    """Nearest multiple of 1/n."""
    return F.floor(c * n + 0.5) / n


def tile_path(lon: Column, lat: Column) -> Column:
    """``+40-080/+47-073``: the ten-degree bucket and the degree tile of a place."""
    name = lambda y, x: F.format_string("%+03d%+04d", y.cast("long"), x.cast("long"))
    return F.concat(name(F.floor(lat / 10) * 10, F.floor(lon / 10) * 10), F.lit("/"), name(F.floor(lat), F.floor(lon)))
