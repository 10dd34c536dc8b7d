"""Great-circle and planar geometry on columns; degrees in, kilometres out, longitude first in rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(h.isNotNull(), F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_KM))  # least() passes over nulls


def flat_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Flat-earth distance, good enough for radii of some tens of kilometres."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lng1 - lng2, 2)) * KM_PER_DEGREE


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial course, clockwise from north, 0 up to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lng: Column, course: Column, km: Column) -> Column:
    """``struct<lng, lat>`` reached from a point; longitude within -180 to 180."""
    d, t, p, l = km / EARTH_KM, F.radians(course), F.radians(lat), F.radians(lng)  # noqa: E741
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t)
    east = l + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s)
    return F.struct((F.pmod(F.degrees(east) + 540, F.lit(360.0)) - 180).alias("lng"), F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s)))).alias("lat"))


def compass(course: Column) -> Column:
    return F.get(F.array(*map(F.lit, COMPASS)), (F.floor(course / 22.5 + 0.5) % 16).cast("int"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, ((i + 1) % F.size(ring)).cast("int"))


def ring_area_km2(ring: Column) -> Column:
    """Spherical area of a ring of ``struct<lng, lat>``, open or closed, in any winding; 0 under three points."""
    terms = F.transform(ring, lambda p, i: F.radians(_next(ring, i)["lng"] - p["lng"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(_next(ring, i)["lat"]))))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(_sum(terms) * (EARTH_KM * EARTH_KM / 2)))


def ring_perimeter_km(ring: Column) -> Column:
    legs = F.transform(ring, lambda p, i: haversine_km(p["lat"], p["lng"], _next(ring, i)["lat"], _next(ring, i)["lng"]))
    return F.when(F.size(ring) < 2, 0.0).otherwise(_sum(legs))


def point_in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of an open or closed ring."""
    def crosses(p: Column, i: Column) -> Column:
        q = _next(ring, i)
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lng < (q["lng"] - p["lng"]) * (lat - p["lat"]) / F.when(q["lat"] == p["lat"], 1.0).otherwise(q["lat"] - p["lat"]) + p["lng"])

    return F.size(F.filter(ring, crosses)) % 2 == 1


def in_box(lat: Column, lng: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def circle_ring(lat: Column, lng: Column, km: Column, steps: int = 64) -> Column:
    """Closed ring of true geodesic radius."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: destination(lat, lng, (i % steps) * (360.0 / steps), km))


def rect_ring(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    w, e, s, n = F.least(lng1, lng2), F.greatest(lng1, lng2), F.least(lat1, lat2), F.greatest(lat1, lat2)
    return F.array(*[F.struct(x.alias("lng"), y.alias("lat")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])


def great_circle_point(lat1: Column, lng1: Column, lat2: Column, lng2: Column, share: Column) -> Column:
    """``struct<lng, lat>`` at a share of the way between two points."""
    d = haversine_km(lat1, lng1, lat2, lng2)
    return destination(lat1, lng1, bearing_deg(lat1, lng1, lat2, lng2), d * share)


def wrap_longitude(lng: Column) -> Column:
    return F.pmod(lng + 180, F.lit(360.0)) - 180


def orbital_period_minutes(mean_motion: Column) -> Column:
    return F.when(mean_motion > 0, 1440.0 / mean_motion)


def mercator_metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.cos(F.radians(lat)) * (2 * math.pi * 6378137 / 256) / F.pow(F.lit(2.0), zoom)


def box_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    return (north - south) * KM_PER_DEGREE * (east - west) * KM_PER_DEGREE * F.cos(F.radians((north + south) / 2))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at a decimal place, also for negative numbers."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def format_distance(km: Column) -> Column:
    return (
        F.when(km < 1, F.concat(round_half_up(km * 1000).cast("string"), F.lit(" m")))
        .when(km < 100, F.concat(_fixed(km, 1), F.lit(" km"))).otherwise(F.concat(F.format_number(round_half_up(km), 0), F.lit(" km")))
    )


def format_area(km2: Column) -> Column:
    return (
        F.when(km2 < 0.01, F.concat(F.format_number(round_half_up(km2 * 1e6), 0), F.lit(" m²")))
        .when(km2 < 100, F.concat(_fixed(km2, 2), F.lit(" km²"))).otherwise(F.concat(F.format_number(round_half_up(km2), 0), F.lit(" km²")))
    )


def format_ago(seconds: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u))
    return F.when(seconds < 60, unit(1, "s ago")).when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def format_duration(seconds: Column) -> Column:
    """Minutes, at least one; from an hour on, hours and minutes."""
    total = F.greatest(F.lit(1), round_half_up(seconds / 60))
    hours, minutes = F.floor(total / 60).cast("string"), total % 60
    hour_text = F.concat(hours, F.lit(" hr"))
    return F.when(total < 60, F.concat(total.cast("string"), F.lit(" min"))).when(minutes == 0, hour_text).otherwise(F.concat(hour_text, F.lit(" "), minutes.cast("string"), F.lit(" min")))


def to_feet(metres: Column) -> Column:
    """Feet, to the nearest 25."""
    return round_half_up(metres * 3.28084 / 25) * 25


def format_altitude(metres: Column, grounded: Column) -> Column:
    """Feet with separators; Ground on the ground, a dash where the altitude is missing or no finite number."""
    finite = metres.isNotNull() & ~F.isnan(metres) & (F.abs(metres) != float("inf"))
    return F.when(F.coalesce(grounded, F.lit(False)), "Ground").when(finite, F.concat(F.format_number(to_feet(metres), 0), F.lit(" ft"))).otherwise("—")
