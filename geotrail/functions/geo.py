"""Spherical and planar geometry as column expressions (radius 6,371,000 m)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres between two places."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def destination(lat: Column, lng: Column, bearing_rad: Column, metres: Column) -> Column:
    """``struct<lat, lng>`` of the place ``metres`` away in a direction (radians east of north); lng in [-180, 180)."""
    d, p, q = metres / EARTH_M, F.radians(lat), F.radians(lng)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(bearing_rad))
    lng2 = q + F.atan2(F.sin(bearing_rad) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), (F.pmod(F.degrees(lng2) + 540, F.lit(360.0)) - 180).alias("lng"))


def flat_bearing(dlat: Column, dlng: Column) -> Column:
    """Direction by coordinate differences, in radians east of north."""
    return F.atan2(dlng, dlat)


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area of a ring of [lng, lat] points, in square degrees."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, turned, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


def ring_centre(geometry: Column) -> Column:
    """``struct<lat, lng>``: the mean of the vertices of the ring with most vertices."""
    rings = F.flatten(geometry)
    longest = F.aggregate(rings, F.element_at(rings, 1), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))
    mean = lambda axis: F.aggregate(longest, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(longest)
    return F.struct(mean(1).alias("lat"), mean(0).alias("lng"))


def _edges(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("p"), nxt.alias("q"))


def _meets(ring: Column, lat: Column, lng: Column) -> tuple[Column, Column]:
    """(number of the ring's edges that a ray to the east crosses, whether the point lies on an edge)."""

    def turn(e: Column) -> Column:
        return (e["q"][0] - e["p"][0]) * (lat - e["p"][1]) - (lng - e["p"][0]) * (e["q"][1] - e["p"][1])

    def crossing(e: Column) -> Column:
        return ((e["p"][1] > lat) != (e["q"][1] > lat)) & ((turn(e) > 0) == (e["q"][1] > e["p"][1]))

    def on(e: Column) -> Column:
        between = lambda v, k: (F.least(e["p"][k], e["q"][k]) <= v) & (v <= F.greatest(e["p"][k], e["q"][k]))
        return (turn(e) == 0) & between(lng, 0) & between(lat, 1)

    edges = _edges(ring)
    return F.size(F.filter(edges, crossing)), F.exists(edges, on)


def contains(geometry: Column, lat: Column, lng: Column) -> Column:
    """Whether a multi-polygon (array<polygon<ring<[lng, lat]>>>) contains a point, by the even-odd rule over all rings; borders belong to it."""
    rings = F.flatten(geometry)
    flips = F.aggregate(F.transform(rings, lambda r: _meets(r, lat, lng)[0]), F.lit(0), lambda s, n: s + n)
    return (flips % 2 == 1) | F.exists(rings, lambda r: _meets(r, lat, lng)[1])


def outline_contains(geometry: Column, lat: Column, lng: Column) -> Column:
    """The same by the outer rings alone; holes do not count."""

    def inside(polygon: Column) -> Column:
        n, on = _meets(polygon[0], lat, lng)
        return (n % 2 == 1) | on

    return F.exists(geometry, inside)


def segment_distance_m(lat: Column, lng: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to an edge, on a plane scaled at the point's latitude (110,540 m and 111,320 m a degree)."""
    kx, ky = F.cos(F.radians(lat)) * 111_320.0, F.lit(110_540.0)
    ax, ay, bx, by = (x1 - lng) * kx, (y1 - lat) * ky, (x2 - lng) * kx, (y2 - lat) * ky
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(size, F.lit(0.0)))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def edge_distance_m(geometry: Column, lat: Column, lng: Column) -> Column:
    """Least metres from a point to an edge of a multi-polygon."""
    one = lambda e: segment_distance_m(lat, lng, e["p"][0], e["p"][1], e["q"][0], e["q"][1])
    return F.array_min(F.transform(F.flatten(F.transform(F.flatten(geometry), _edges)), one))


def bounds(geometry: Column) -> Column:
    """``struct<min_lng, max_lng, min_lat, max_lat>`` of a multi-polygon."""
    points = F.flatten(F.flatten(geometry))
    lng, lat = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(lng).alias("min_lng"), F.array_max(lng).alias("max_lng"), F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"))
