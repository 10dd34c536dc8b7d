"""Small classifiers and lookups on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandline.functions.geo import haversine_km, in_box

# Registration prefixes, altitude range of the display map, overlapping boxes in their order.
REGISTRATIONS = {
    "N": "United States", "G": "United Kingdom", "F": "France", "D": "Germany", "I": "Italy", "JA": "Japan", "HL": "South Korea", "B": "China", "VT": "India",
    "TC": "Turkey", "SU": "Russia", "RA": "Russia", "UR": "Ukraine", "A6": "UAE", "A7": "Qatar", "9V": "Singapore", "VH": "Australia", "C": "Canada",
    "PP": "Brazil", "PR": "Brazil", "PT": "Brazil", "EC": "Spain", "PH": "Netherlands", "HS": "Thailand", "9M": "Malaysia", "PK": "Pakistan", "EP": "Iran",
    "YI": "Iraq", "HZ": "Saudi Arabia", "4X": "Israel", "SX": "Greece", "OE": "Austria", "HB": "Switzerland", "SE": "Sweden", "OH": "Finland", "LN": "Norway",
    "OY": "Denmark", "OO": "Belgium", "CS": "Portugal", "SP": "Poland", "OK": "Czech Republic", "HA": "Hungary", "YR": "Romania", "LZ": "Bulgaria",
    "EI": "Ireland", "EW": "Belarus", "ES": "Estonia", "YL": "Latvia", "LY": "Lithuania",
}
MACRO_REGIONS = (
    ("east-asia", 18, 50, 90, 150), ("southeast-asia", -12, 25, 92, 141), ("south-asia", 5, 37, 60, 92), ("russia-eurasia", 46, 82, 30, 180), ("europe", 35, 72, -25, 40),
    ("middle-east", 12, 42, 25, 60), ("africa", -36, 38, -26, 60), ("latam-caribbean", -57, 23.5, -120, -30), ("oceania", -50, 5, 110, 180), ("north-america", 23.5, 85, -170, -50),
)
POI_KEYS = ("amenity", "tourism", "shop", "leisure", "historic", "office", "railway", "aeroway", "natural", "man_made")


def registration_country(registration: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REGISTRATIONS.items() for x in kv])
    return F.coalesce(table[F.substring(registration, 1, 2)], table[F.substring(registration, 1, 1)])


def macro_region(lat: Column, lng: Column) -> Column:
    """The first box that holds the point; the order of overlapping boxes counts."""
    return F.coalesce(*[F.when(in_box(lat, lng, F.lit(s), F.lit(n), F.lit(w), F.lit(e)), name) for name, s, n, w, e in MACRO_REGIONS], F.lit("other"))


def feed_kind(stream_type: Column, feed_url: Column, stream_url: Column, external_url: Column) -> Column:
    s = F.lower(F.trim(stream_type))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        F.when(s.isin("hls", "iframe", "mjpeg"), s).when(has(s) & (s != "jpg"), "video").when(has(feed_url), "snapshot").when(has(stream_url), "video")
        .when(has(external_url), "external").otherwise("unknown")
    )


def snapshot_url(stream_type: Column, feed_url: Column, stream_url: Column) -> Column:
    """A still picture's URL, never a stream's."""
    kind = F.lower(F.coalesce(F.nullif(stream_type, F.lit("")), F.lit("jpg")))
    streams = (kind == "mjpeg") | ((kind != "jpg") & F.coalesce(feed_url == stream_url, F.lit(False)))
    return F.when(~streams, F.when(kind == "jpg", F.coalesce(F.nullif(feed_url, F.lit("")), stream_url)).when(feed_url.rlike(r"(?i)\.(?:jpe?g|png|webp)(?:[?#]|$)"), feed_url))


def asset_type(text: Column) -> Column:
    q = F.trim(text)
    return F.when(q.contains("@"), "email").when(q.rlike(r"^\+?[0-9][0-9\s().-]{6,}$"), "phone").when(q.rlike(r"(?i)^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)+$"), "domain").otherwise("username")


def as_number(text: Column) -> Column:
    """``struct<asn, name>`` of ``AS15169 Some Name``."""
    return F.struct(F.regexp_extract(text, r"^AS(\d+)\s*(.*)$", 1).try_cast("long").alias("asn"), F.nullif(F.regexp_extract(text, r"^AS(\d+)\s*(.*)$", 2), F.lit("")).alias("name"))


def place_kind(key: Column, value: Column) -> Column:
    place = key == "place"
    return (
        F.when(key.isNull() | (key == ""), "place").when(place & (value == "country"), "country").when(place & value.isin("state", "region", "province", "county"), "region")
        .when(place & value.isin("city", "town", "village", "hamlet", "municipality"), "city").when(key == "boundary", "region").when(key.isin("highway", "street"), "street")
        .when(key.isin("building", "address") | (value == "house"), "address").when(key.isin(*POI_KEYS), "poi").otherwise("place")
    )


def display_share(alt_km: Column, low: float = 150, high: float = 36000) -> Column:
    """Where an altitude stands between the lowest and the highest one, by square roots."""
    return (F.sqrt(F.least(F.lit(high), F.greatest(F.lit(low), alt_km))) - F.sqrt(F.lit(low))) / (F.sqrt(F.lit(high)) - F.sqrt(F.lit(low)))


def leg_clock(lat1: Column, lng1: Column, lat2: Column, lng2: Column, lat: Column, lng: Column, knots: Column) -> Column:
    """``struct<done_h, left_h, progress>`` along a flight; 800 km/h where the speed is missing or too low."""
    total, done, left = haversine_km(lat1, lng1, lat2, lng2), haversine_km(lat1, lng1, lat, lng), haversine_km(lat, lng, lat2, lng2)
    kmh = F.when(knots > 50, knots * 1.852).otherwise(800.0)
    return F.struct((done / kmh).alias("done_h"), (left / kmh).alias("left_h"), F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0).alias("progress"))


def http_url(text: Column) -> Column:
    """The text if it is an http(s) URL, else null."""
    return F.when(text.rlike(r"(?i)^https?://[^\s]+$"), text)


def stored_shapes(raw: Column) -> Column:
    """The well-formed shapes of a stored JSON array; a bad one is left out, text that isn't an array gives none."""
    kind = "array<struct<id:string,name:string,kind:string,geojson:struct<geometry:struct<type:string,coordinates:string>>,areaKm2:double>>"
    g = lambda s: s["geojson"]["geometry"]
    fine = lambda s: F.coalesce(s["id"].isNotNull() & s["name"].isNotNull() & g(s)["type"].isin("Polygon", "LineString") & g(s)["coordinates"].rlike(r"^\[.+\]$"), F.lit(False))
    return F.coalesce(F.filter(F.from_json(raw, kind), fine), F.array().cast(kind))


# Kinds of a manoeuvre by number, instructions with and without a direction, shapes of an asset's addresses.
MANOEUVRES = {
    "depart": (1, 2, 3), "arrive": (4, 5, 6), "straight": (7, 8), "right": (9, 10, 11), "left": (13, 14), "roundabout": (15, 16, 17, 18, 19, 20), "merge": (25, 26, 27),
}
INSTRUCTIONS = {
    "merge": ("Merge {}", "Merge"), "on ramp": ("Take the ramp", "Take the ramp"), "off ramp": ("Take the exit", "Take the exit"), "fork": ("Keep {}", "Keep straight"),
    "end of road": ("Turn {}", "Turn straight"), "continue": ("Keep {}", "Continue"), "new name": ("Continue", "Continue"), "turn": ("Turn {}", "Continue"),
}
ASSET_SHAPES = (
    ("ETH", "^0x[a-fA-F0-9]{40}$"), ("BTC", "^(?:bc1[a-z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})$"), ("XMR", "^4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}$"),
    ("TRX", "^T[1-9A-HJ-NP-Za-km-z]{33}$"),
)


def manoeuvre_kind(number: Column) -> Column:
    return F.coalesce(*[F.when(number.isin(*numbers), kind) for kind, numbers in MANOEUVRES.items()], F.lit("straight"))


def instruction(kind: Column, direction: Column, road: Column, exit_number: Column) -> Column:
    """What a driver is told; an unknown kind is a turn, and going on straight needs no direction."""
    road, way = F.trim(F.coalesce(road, F.lit(""))), F.coalesce(direction, F.lit(""))
    onto = F.when(road != "", F.concat(F.lit(" onto "), road)).otherwise("")
    way = F.when((kind == "continue") & (way == "straight"), "").otherwise(way)
    told = lambda pair: F.when(way != "", F.replace(F.lit(pair[0]), F.lit("{}"), way)).otherwise(pair[1])
    steps = F.coalesce(*[F.when(kind == name, told(pair)) for name, pair in INSTRUCTIONS.items()], told(INSTRUCTIONS["turn"]))
    circle = F.when(exit_number > 0, F.concat(F.lit("At the roundabout, take exit "), exit_number.cast("string"))).otherwise("Enter the roundabout")
    return (
        F.when(kind == "depart", F.when(road != "", F.concat(F.lit("Head out on "), road)).otherwise("Depart")).when(kind == "arrive", "You have arrived at your destination")
        .when(kind.isin("roundabout", "rotary"), F.concat(circle, onto)).otherwise(F.concat(steps, onto))
    )


def address_asset(name: Column) -> Column:
    """The asset whose addresses have the shape of the name; null if none."""
    return F.coalesce(*[F.when(name.rlike(shape), asset) for asset, shape in ASSET_SHAPES])


def threat_level(reports: Column) -> Column:
    """By the number of reports that name an indicator: over five is high, any is medium; none or null is low."""
    return F.when(reports > 5, "HIGH").when(reports > 0, "MEDIUM").otherwise("LOW")
