"""Geometry on small areas."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopclock.fixed import EARTH_RADIUS_M, METRES_PER_LAT_DEGREE, METRES_PER_LON_DEGREE


def local_metres(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular x and y around a reference latitude."""
    x = F.radians(lon) * F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0))
    return x, F.radians(lat) * F.lit(EARTH_RADIUS_M)


def project_onto_segment(
    lat: Column,
    lon: Column,
    start: tuple[Column, Column, Column],
    end: tuple[Column, Column, Column],
) -> tuple[Column, Column]:
    """(offset along the route, distance to it) of the closest point of one segment.

    `start` and `end` are (lat, lon, offset_m).
    """
    lat0 = (start[0] + end[0]) / 2
    px, py = local_metres(lat, lon, lat0)
    ax, ay = local_metres(start[0], start[1], lat0)
    bx, by = local_metres(end[0], end[1], lat0)
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = ((px - ax) * dx + (py - ay) * dy) / square
    share = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)))
    offset = start[2] + share * (end[2] - start[2])
    return offset, F.hypot(px - (ax + share * dx), py - (ay + share * dy))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = (
        F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(half))


def heading(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north; null when the two points coincide."""
    turn = F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(turn)
    still = (F.abs(x) < 1e-12) & (F.abs(y) < 1e-12)
    return F.when(~still, F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)))


def planar_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot((lon2 - lon1) * METRES_PER_LON_DEGREE, (lat2 - lat1) * METRES_PER_LAT_DEGREE)


def interpolate_time(
    before_us: Column, after_us: Column, before_m: Column, after_m: Column, target_m: Column
) -> Column:
    """Epoch micros at which a distance was passed, on the line between two track points."""
    span = after_m - before_m
    share = F.least(F.greatest((target_m - before_m) / span, F.lit(0.0)), F.lit(1.0))
    moved = before_us + F.floor((after_us - before_us) * share + 0.5)
    return F.when(span <= 0, before_us).otherwise(moved)
