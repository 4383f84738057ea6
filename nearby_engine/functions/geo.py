"""Great-circle geometry and map cells as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby_engine.functions.text import let

# Mean sphere radius for distances, equatorial radius and
# circumference for web-mercator cells, the mercator latitude limit.
EARTH_RADIUS_M = 6371000.0
MERCATOR_RADIUS_M = 6378137.0
MERCATOR_CIRCUMFERENCE_M = 40075016.68557849
MERCATOR_MAX_LAT = 85.05112878

Number = Column | float


def _col(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def distance_m(lat1: Number, lng1: Number, lat2: Number, lng2: Number) -> Column:
    """Haversine distance in metres."""
    phi1, phi2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_lat = F.sin((phi2 - phi1) / 2.0)
    half_lng = F.sin(F.radians(_col(lng2) - _col(lng1)) / 2.0)
    h = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_lng * half_lng
    return F.atan2(F.sqrt(h), F.sqrt(F.greatest(1.0 - h, F.lit(0.0)))) * (2.0 * EARTH_RADIUS_M)


def in_box(lat: Column, lng: Column, center_lat: float, center_lng: float, radius_m: float) -> Column:
    """Latitude/longitude ranges that enclose the circle; plain comparisons, so they reach the scan."""

    def inside(west: float, south: float, east: float, north: float) -> Column:
        rows = lat.between(south, north)
        return rows if (west, east) == (-180.0, 180.0) else rows & lng.between(west, east)

    return reduce(Column.__or__, [inside(*box) for box in _boxes(center_lat, center_lng, radius_m)])


def in_radius(lat: Column, lng: Column, center_lat: float, center_lng: float, radius_m: float) -> Column:
    """True within the radius, edge included."""
    return in_box(lat, lng, center_lat, center_lng, radius_m) & (
        distance_m(lat, lng, center_lat, center_lng) <= F.lit(float(radius_m))
    )


# Bits of latitude and of longitude in a space code: cells of about 600 by 300 metres at most.
CODE_BITS = 16


def _spread(value: Column) -> Column:
    """The bits of a 16-bit number, a free place after each."""

    def apart(value: Column, shift: int, mask: int) -> Column:
        return let(value, lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long")))

    return apart(apart(apart(apart(value, 8, 0x00FF00FF), 4, 0x0F0F0F0F), 2, 0x33333333), 1, 0x55555555)


def space_code(lat: Column, lng: Column) -> Column:
    """Position on a space-filling curve over the globe: points that are close mostly have close codes. Null without a point."""
    most = (1 << CODE_BITS) - 1
    step = lambda share: F.greatest(F.least(F.floor(share * (1 << CODE_BITS)), F.lit(most).cast("long")), F.lit(0).cast("long"))
    x, y = step((lng + 180.0) / 360.0), step((lat + 90.0) / 180.0)
    return F.when(lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng), _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)))


def _boxes(center_lat: float, center_lng: float, radius_m: float) -> list[tuple[float, float, float, float]]:
    """West, south, east, north of the boxes that enclose a circle; two where it crosses the date line."""
    angle = radius_m / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12
    south, north = center_lat - math.degrees(angle), center_lat + math.degrees(angle)
    if south <= -90.0 or north >= 90.0:
        return [(-180.0, max(south, -90.0), 180.0, min(north, 90.0))]
    spread = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(center_lat))))) + 1e-9
    west, east = center_lng - spread, center_lng + spread
    if west < -180.0:
        return [(west + 360.0, south, 180.0, north), (-180.0, south, east, north)]
    if east > 180.0:
        return [(west, south, 180.0, north), (-180.0, south, east - 360.0, north)]
    return [(west, south, east, north)]


def code_ranges(center_lat: float, center_lng: float, radius_m: float, most: int = 16) -> list[tuple[int, int]]:
    """At most about ``most`` ranges of space codes that hold every point of the circle, found by halving the globe."""
    boxes = _boxes(center_lat, center_lng, radius_m)

    def met(x: int, y: int, level: int) -> tuple[bool, bool]:
        """Whether a cell touches a box, and whether it lies inside one."""
        wide, high = 360.0 / (1 << level), 180.0 / (1 << level)
        w, s = x * wide - 180.0, y * high - 90.0
        touches = any(w <= b[2] and w + wide >= b[0] and s <= b[3] and s + high >= b[1] for b in boxes)
        return touches, any(w >= b[0] and w + wide <= b[2] and s >= b[1] and s + high <= b[3] for b in boxes)

    cells, level = [(0, 0, 0)], 0
    whole: list[tuple[int, int, int]] = []
    while level < CODE_BITS:
        finer = []
        for x, y, code in cells:
            for part in range(4):
                child = (2 * x + (part & 1), 2 * y + (part >> 1), 4 * code + part)
                touches, inside = met(*child[:2], level + 1)
                if inside:
                    whole.append((child[2], level + 1, 0))
                elif touches:
                    finer.append(child)
        if level > 0 and len(finer) + len(whole) > most:
            break
        cells, level = finer, level + 1
    spans = [(code << 2 * (CODE_BITS - lv), ((code + 1) << 2 * (CODE_BITS - lv)) - 1) for code, lv, _ in [*((c, level, 0) for _, _, c in cells), *whole]]
    joined: list[list[int]] = []
    for low, high in sorted(spans):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    return [tuple(j) for j in joined]


def in_codes(code: Column, center_lat: float, center_lng: float, radius_m: float) -> Column:
    """Ranges of codes that enclose the circle; plain comparisons, so they reach the scan and skip row groups."""
    return reduce(Column.__or__, [code.between(low, high) for low, high in code_ranges(center_lat, center_lng, radius_m)])


def in_viewport(lat: Column, lng: Column, west: float, south: float, east: float, north: float) -> Column:
    return lng.between(float(west), float(east)) & lat.between(float(south), float(north))


def mercator_cell_x(lng: Column, zoom: int) -> Column:
    size = MERCATOR_CIRCUMFERENCE_M / float(1 << zoom)
    return F.floor(F.radians(lng) * MERCATOR_RADIUS_M / size)


def mercator_cell_y(lat: Column, zoom: int) -> Column:
    size = MERCATOR_CIRCUMFERENCE_M / float(1 << zoom)
    bounded = F.greatest(F.least(lat, F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))
    return F.floor(F.log(F.tan(F.lit(math.pi / 4) + F.radians(bounded) / 2.0)) * MERCATOR_RADIUS_M / size)


def sphere_cell(lat: Column, lng: Column, side_m: float) -> Column:
    """Cube of ``side_m`` around the point on the sphere.

    Chords are never longer than arcs, so two points within ``side_m`` always lie in the
    same or in touching cubes. Cubes have no poles and no date line to treat apart.
    """
    phi, lam = F.radians(lat), F.radians(lng)
    scale = EARTH_RADIUS_M / side_m
    return F.struct(
        F.floor(F.cos(phi) * F.cos(lam) * scale).alias("x"),
        F.floor(F.cos(phi) * F.sin(lam) * scale).alias("y"),
        F.floor(F.sin(phi) * scale).alias("z"),
    )


def touching_cells(cell: Column) -> Column:
    """The cube itself and the 26 around it, as an array."""

    def moved(i: Column) -> Column:
        return F.struct(
            (cell["x"] + i % 3 - 1).alias("x"),
            (cell["y"] + F.floor(i / 3) % 3 - 1).alias("y"),
            (cell["z"] + F.floor(i / 9) - 1).alias("z"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(26)), moved)


def valid_pair(lat: Column, lng: Column) -> Column:
    """Both present and inside the bounds of latitude and longitude (NaN is outside)."""
    return F.coalesce(lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0), F.lit(False))
