"""Classes of aircraft and satellites, by rules kept as data: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Type designators, operators, callsign words and emitter categories by class, and keywords of satellite names.
HELICOPTERS = """R22 R44 R66 B06 B06T B204 B205 B206 B212 B222 B230 B407 B412 B427 B429 B430 B505 B525 AS32 AS35 AS50 AS55 AS65 EC20 EC25 EC30 EC35 EC45
 EC55 EC75 H125 H130 H135 H145 H155 H160 H175 H215 H225 S55 S58 S61 S64 S70 S76 S92 A109 A119 A139 A169 A189 AW09 MD52 MD60 MDHI MD90 NOTR B47G HUEY GAMA CABR EXE""".split()
MILITARY = """C17 C5M C130 C30J KC10 KC46 KC35 E3CF E3TF E8A B1B B2 B52 F16 F15 F18 F22 F35 A10 F117 RC135 E6B P8A P3 MQ9 RQ4 U2 EP3 RC12 V22 CH47 UH60 AH64
 AH1Z MV22 EUFI RFAL TORD TYP GR4""".split()
AIRLINERS = "A319 A320 A321 A332 A333 A339 A343 A359 A388 B737 B738 B739 B38M B39M B752 B753 B763 B764 B772 B77L B77W B788 B789 B78X E170 E175 E190 E195 CRJ7 CRJ9 AT43 AT72 DH8D".split()
JETS = """G150 G200 G280 GLEX G500 G550 G600 G650 G700 GLF2 GLF3 GLF4 GLF5 GLF6 GL5T GL7T GV GIV CL30 CL35 CL60 BD70 BD10 C25A C25B C25C C500 C510 C525 C550 C560
 C56X C680 C700 C750 E35L E50P E55P E545 E550 FA50 FA7X FA8X F900 F2TH LJ35 LJ40 LJ45 LJ60 LJ70 LJ75 PC12 PC24 TBM7 TBM8 TBM9 PRM1 SF50 EA50 VLJ""".split()
JET_OPERATORS = "EJA EJM NJE LXJ FJO VJT XOJ JTL WUP GAJ DPJ CLY TWY".split()
MILITARY_SIGNS = "RCH KING DUKE EVAC JAKE REACH CONVOY".split()
EMITTERS = {14: "military", 4: "commercial", 5: "commercial", 6: "commercial", 7: "jet", 2: "private"}
HELICOPTER_EMITTER, TOWER = 8, "TWR"
JET_CRUISE_M, JET_CRUISE_KNOTS = 8500, 300
MISSIONS = (
    ("USA", "Military Recon"), ("NROL", "NRO Classified"), ("LACROSSE", "SAR Imaging"), ("MENTOR", "SIGINT"), ("ORION", "SIGINT"), ("TRUMPET", "SIGINT"), ("GPS", "Navigation"), ("NAVSTAR", "Navigation"),
    ("GLONASS", "Navigation"), ("GALILEO", "Navigation"), ("BEIDOU", "Navigation"), ("SBIRS", "Early Warning"), ("DSP", "Early Warning"), ("STARLINK", "Commercial Comms"), ("ONEWEB", "Commercial Comms"),
    ("PLANET", "Earth Imaging"), ("WORLDVIEW", "Commercial Imaging"), ("ISS", "Space Station"), ("TIANGONG", "Space Station"), ("COSMOS", "Russian Military"), ("YAOGAN", "Chinese Recon"), ("FENGYUN", "Weather"),
    ("GOES", "Weather"), ("NOAA", "Weather"), ("METEOSAT", "Weather"), ("LANDSAT", "Earth Observation"), ("SENTINEL", "Earth Observation"), ("TERRA", "Earth Science"), ("AQUA", "Earth Science"),
    ("HUBBLE", "Space Telescope"), ("JAMES WEBB", "Space Telescope"),
)
# End of fixed values.

#: Which class wins where several fit.
RANKS = {"military": 1, "commercial": 2, "jet": 3, "private": 4}


def flight_rules() -> list[tuple[str, str, int, str]]:
    """``field, value, rank, label``: a rule a row."""
    said = [("type", MILITARY, "military"), ("type", AIRLINERS, "commercial"), ("type", JETS, "jet"), ("operator", JET_OPERATORS, "jet"), ("sign", MILITARY_SIGNS, "military")]
    rows = [(field, value, RANKS[label], label) for field, values, label in said for value in values]
    return rows + [("emitter", str(code), RANKS[label], label) for code, label in EMITTERS.items()]


def classified_flights(flights: DataFrame, rules: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """Adds ``callsign, airline_code, craft, category, grounded, alt_m`` to ``flight, hex, type, emitter, flags, lat, lng, alt_ft, knots``.

    Towers and flights without a place are left out.  Each field that rules name is looked up in its rows, and of what is
    found the lowest rank decides: military, airliner, business jet, private, else commercial.  A callsign that is no
    airline code and number is a registration, hence private, or a jet if it cruises like one.  Text is compared in upper
    case; null fields fit no rule; a null altitude or speed is 0.  The rules are some 200 constant rows, sent to all tasks.
    """
    spark = flights.sparkSession
    upper = lambda c: F.upper(F.coalesce(F.col(c).cast("string"), F.lit("")))
    sign = F.trim(upper("flight"))
    metres = F.coalesce(F.col("alt_ft").cast("double"), F.lit(0.0)) * 0.3048
    rows = flights.where("lat IS NOT NULL AND lng IS NOT NULL").where(upper("type") != TOWER)
    rows = rows.withColumn("callsign", F.when(sign != "", sign).when(F.coalesce("hex", F.lit("")) != "", F.col("hex")).otherwise("UNKNOWN"))
    rows = rows.withColumn("airline_code", F.regexp_extract("callsign", "^([A-Z]{3})[0-9]", 1))
    registered = (F.col("airline_code") == "") & sign.rlike("^[A-Z0-9]{3,8}$")
    fast = (metres > JET_CRUISE_M) & (F.coalesce(F.round(F.col("knots") * 10) / 10, F.lit(0.0)) > JET_CRUISE_KNOTS)
    fields = {"type": upper("type"), "operator": F.col("airline_code"), "sign": F.regexp_extract(upper("flight"), "^([A-Z]+)[0-9]", 1), "emitter": F.col("emitter").cast("string")}
    table = spark.createDataFrame(rules or flight_rules(), "field string, value string, rank int, label string")
    found = []
    for field, value in fields.items():
        own = table.where(F.col("field") == field).groupBy(F.col("value").alias(f"_{field}")).agg(F.min(F.struct("rank", "label")).alias(f"_by_{field}"))
        rows = rows.withColumn(f"_{field}", value).join(F.broadcast(own), f"_{field}", "left")
        found.append(F.col(f"_by_{field}"))
    by = lambda label: F.struct(F.lit(RANKS[label]).alias("rank"), F.lit(label).alias("label"))
    flagged = F.when(F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(1) == 1, by("military"))
    first = F.least(*found, flagged, F.when(registered & fast, by("jet")), F.when(registered, by("private")))
    helicopter = F.col("_type").isin(*HELICOPTERS) | F.coalesce(F.col("emitter") == HELICOPTER_EMITTER, F.lit(False))
    return rows.select(
        *flights.columns, "callsign", "airline_code", F.when(helicopter, "heli").otherwise("plane").alias("craft"), F.coalesce(first["label"], F.lit("commercial")).alias("category"),
        F.coalesce(F.col("alt_ft") < 100, F.lit(False)).alias("grounded"), F.floor(metres + 0.5).cast("long").alias("alt_m"),
    )


def mission(name: Column) -> Column:
    """The mission that the first keyword found in a satellite's name stands for; Unknown if none is, or for a null name."""
    rules = F.array(*[F.struct(F.lit(k).alias("word"), F.lit(m).alias("mission")) for k, m in MISSIONS])
    return F.coalesce(F.get(F.filter(rules, lambda r: F.contains(F.upper(name), r.word)), F.lit(0))["mission"], F.lit("Unknown"))
