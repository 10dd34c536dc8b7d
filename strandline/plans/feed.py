"""Feed, grid, page and geometry queries."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from strandline.functions import geo
from strandline.operators import feed, spatial
from strandline.sources.adapters import NOW_MS, SIGNALS_SQL, TRACKS_SQL, key_lat, key_lng, places, places_sql, signals, table, tracks

R6 = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
r6 = lambda s: f"floor(({s}) * 1e6 + 0.5) / 1e6"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that it is checked against."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


MAP = "(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND location_confidence >= 0.75)"


@query(f"WITH {SIGNALS_SQL} SELECT id, category, severity, source FROM signals WHERE severity >= 35 AND {MAP} AND category IN ('conflict', 'earthquake', 'weather') ORDER BY severity DESC, id LIMIT 200")
def flt01_feed_filter(spark, sf):
    rows = feed.feed_filter(signals(spark, sf), 35, ["conflict", "earthquake", "weather"], True)
    return rows.orderBy(F.desc("severity"), "id").limit(200).select("id", "category", "severity", "source")


def _states(spark, sf):
    """Signals with a lifecycle, a confidence and a healthy flag."""
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % 3).cast("int"))
    return signals(spark, sf).withColumns({
        "lifecycle": pick(feed.LIFECYCLES, "ord"), "confidence": pick(feed.CONFIDENCES, "user_id"), "change_sequence": F.col("ord"),
        "healthy": F.length("source") % 2 == 0,
    })


STATES = f"""{SIGNALS_SQL}, states AS (SELECT *, ['new', 'updated', 'ongoing'][ord % 3 + 1] AS lifecycle,
  ['confirmed', 'corroborating', 'unconfirmed'][user_id % 3 + 1] AS confidence, ord AS change_sequence, length(source) % 2 = 0 AS healthy FROM signals)"""


@query(f"""WITH {STATES} SELECT id, change_sequence, lifecycle, severity FROM states
  WHERE lifecycle = 'updated' AND severity >= 20 AND change_sequence > 100 AND {MAP} ORDER BY change_sequence LIMIT 300""")
def flt01_delta_page(spark, sf):
    page = feed.delta_page(_states(spark, sf), 100.7, 5_000, min_severity=20, lifecycle="updated", only_mappable=True)
    return page.select("id", "change_sequence", "lifecycle", "severity")


@query(f"""WITH {STATES} SELECT count(*) AS total, count(*) FILTER ({MAP}) AS mappable,
  count(*) FILTER (confidence = 'confirmed') AS confirmed, count(*) FILTER (confidence = 'corroborating') AS corroborating,
  count(*) FILTER (confidence = 'unconfirmed') AS unconfirmed, count(*) FILTER (lifecycle = 'new') AS new_events,
  count(*) FILTER (lifecycle = 'updated') AS updated_events, count(*) FILTER (lifecycle = 'ongoing') AS ongoing_events,
  count(DISTINCT source) AS source_count, count(DISTINCT source) FILTER (healthy) AS healthy_sources FROM states""")
def agg01_feed_totals(spark, sf):
    return feed.feed_totals(_states(spark, sf))


@query(f"""WITH {SIGNALS_SQL} SELECT category, count(*) AS total, count(*) FILTER ({MAP}) AS mappable, count(*) FILTER (severity >= 70) AS high,
  count(*) FILTER (severity BETWEEN 35 AND 69) AS medium, count(*) FILTER (severity < 35) AS low, count(DISTINCT source) AS sources FROM signals GROUP BY category""")
def agg01_feed_rollup(spark, sf):
    return feed.feed_rollup(signals(spark, sf))


@query(f"WITH {SIGNALS_SQL} SELECT id, {MAP} AS strict, location_confidence >= 0.75 AS simple FROM signals")
def flt02_mappable(spark, sf):
    s = signals(spark, sf)
    return s.select("id", feed.mappable(F.col("lat"), F.col("lng"), F.col("location_confidence")).alias("strict"), (F.col("location_confidence") >= 0.75).alias("simple"))


@query(f"""WITH {SIGNALS_SQL}, s AS (SELECT *, user_id % 3 < 2 AS nws, user_id % 3 = 0 AS nws_only, ord % 37 = 0 AS withdrawn, CASE WHEN ord % 4 = 0 THEN occurred_ms + 172800000 END AS expires_ms,
    ['https://x/' || source || '/' || url_key, 'https://x/' || source || '/' || (url_key + 2)] AS urls,
    CASE WHEN user_id % 3 < 2 AND category = 'weather' THEN ['https://x/' || source || '/' || (url_key + 1), 'https://x/' || source || '/' || (url_key + 5)] END AS old FROM signals),
  r AS (SELECT u, max(occurred_ms) AS retired_at FROM (SELECT unnest(old) AS u, occurred_ms FROM s WHERE nws) GROUP BY u),
  g AS (SELECT DISTINCT ord FROM (SELECT ord, occurred_ms, unnest(urls) AS u FROM s WHERE nws_only) JOIN r USING (u) WHERE retired_at >= occurred_ms)
  SELECT ord, id FROM s WHERE NOT withdrawn AND NOT (nws_only AND coalesce(expires_ms <= {NOW_MS}, false)) AND ord NOT IN (SELECT ord FROM g)""")
def flt04_current_reports(spark, sf):
    url = lambda k: F.concat(F.lit("https://x/"), "source", F.lit("/"), (F.col("url_key") + k).cast("string"))
    n = F.col("user_id") % 3
    s = signals(spark, sf).select(
        "ord", "id", "occurred_ms", F.array(F.concat(url(0), F.lit("#top")), url(2)).alias("urls"), F.when((n < 2) & (F.col("category") == "weather"), F.array(url(1), url(5))).alias("supersedes"),
        (n < 2).alias("nws"), (n == 0).alias("nws_only"), (F.col("ord") % 37 == 0).alias("withdrawn"), F.when(F.col("ord") % 4 == 0, F.col("occurred_ms") + 172_800_000).alias("expires_ms"),
    )
    return feed.current_reports(s, NOW_MS, "ord").select("ord", "id")


@query(f"WITH {SIGNALS_SQL} SELECT id, occurred_ms FROM signals WHERE occurred_ms > {NOW_MS} - 86400000 * 3 AND occurred_ms <= {NOW_MS} + 300000")
def flt06_article_window(spark, sf):
    at = F.col("occurred_ms")
    return signals(spark, sf).where((at > NOW_MS - 86400000 * 3) & (at <= NOW_MS + 300000)).select("id", "occurred_ms")


@query(f"""WITH {SIGNALS_SQL}, m AS (SELECT max(occurred_ms) AS top FROM signals)
  SELECT id, category, severity FROM signals, m WHERE severity >= 20 AND {MAP} AND occurred_ms >= top - 172800000 ORDER BY severity DESC, occurred_ms DESC, id LIMIT 300""")
def flt07_world_view(spark, sf):
    s = signals(spark, sf)
    top = s.agg(F.max("occurred_ms").alias("top"))
    rows = feed.feed_filter(s, 20, None, True).join(F.broadcast(top)).where("occurred_ms >= top - 172800000")  # one row
    return rows.orderBy(F.desc("severity"), F.desc("occurred_ms"), "id").limit(300).select("id", "category", "severity")


REGIONS = (("north-atlantic", 30.0, 65.0, -80.0, -10.0), ("europe", 35.0, 72.0, -12.0, 45.0), ("asia", 0.0, 60.0, 45.0, 150.0), ("south", -60.0, 0.0, -180.0, 180.0))


@query(f"""WITH r(name, s, n, w, e) AS (VALUES {', '.join(map(str, REGIONS))}), c AS {places_sql('customer', 'c_custkey')}
  SELECT c_custkey, coalesce(string_agg(name, ',' ORDER BY name), 'global') AS regions FROM c LEFT JOIN r ON lat BETWEEN s AND n AND lng BETWEEN w AND e GROUP BY c_custkey""")
def flt08_region_routing(spark, sf):
    c = places(spark, sf, "customer", "c_custkey")
    regions = spark.createDataFrame(REGIONS, "name string, s double, n double, w double, e double")
    hit = geo.in_box(F.col("lat"), F.col("lng"), F.col("s"), F.col("n"), F.col("w"), F.col("e"))
    found = c.join(F.broadcast(regions), hit, "left").groupBy("c_custkey").agg(F.array_sort(F.collect_list("name")).alias("names"))  # four rows
    return found.select("c_custkey", F.when(F.size("names") == 0, "global").otherwise(F.array_join("names", ",")).alias("regions"))


LEVELS = ("NONE", "LOW", "ELEVATED", "HIGH", "CRITICAL")


@query(f"""WITH {SIGNALS_SQL}, t AS (SELECT id, ['NONE','LOW','ELEVATED','HIGH','CRITICAL'][severity // 25 + 1] AS level, severity // 25 AS n FROM signals) SELECT id, level FROM t WHERE n >= 3""")
def flt09_threat_threshold(spark, sf):
    levels = F.array(*map(F.lit, LEVELS))
    t = signals(spark, sf).withColumn("level", F.get(levels, F.floor(F.col("severity") / 25).cast("int")))
    return t.where(F.array_position(levels, F.col("level")) >= F.array_position(levels, F.lit("HIGH"))).select("id", "level")


@query(f"WITH {SIGNALS_SQL} SELECT id, CASE WHEN url_key % 10 = 0 THEN 'cached' WHEN {NOW_MS} - occurred_ms > 180000 * 100 THEN 'stale' ELSE 'fresh' END AS freshness FROM signals")
def flt10_freshness(spark, sf):
    age = F.lit(NOW_MS) - F.col("occurred_ms")
    return signals(spark, sf).select("id", F.when(F.col("url_key") % 10 == 0, "cached").when(age > 180000 * 100, "stale").otherwise("fresh").alias("freshness"))


@query(f"""WITH {TRACKS_SQL} SELECT ord, craft FROM tracks WHERE ord % 9 <= 4 AND NOT on_ground""")
def flt11_jamming_candidates(spark, sf):
    return tracks(spark, sf).where((F.col("ord") % 9 <= 4) & ~F.col("on_ground")).select("ord", "craft")


@query(f"""WITH {SIGNALS_SQL}, c AS (SELECT floor((lng / 12 + 180) / 0.75) AS cell_x, floor((lat / 12 + 90) / 0.75) AS cell_y, lat / 12 AS lat, lng / 12 AS lng, value, severity, occurred_ms FROM signals),
  g AS (SELECT CAST(cell_x AS BIGINT) AS cell_x, CAST(cell_y AS BIGINT) AS cell_y, count(*) AS n, avg(lat) AS lat, avg(lng) AS lng, sum(value / 10) AS frp_sum, max(value / 10) AS frp_max, max(severity) AS brightness_max, max(occurred_ms) AS latest_ms FROM c GROUP BY ALL),
  h AS (SELECT *, CAST(least(94, greatest(35, floor(34 + least(24e0, 6 * log2(n + 1)) + least(28e0, 11 * log10(frp_sum + 1)) + 0.5))) AS INTEGER) AS severity FROM g WHERE n >= 3 OR frp_sum >= 25 OR frp_max >= 20)
  SELECT cell_x, cell_y, n, {r6('lat')} AS lat, {r6('lng')} AS lng, {r6('frp_sum')} AS frp_sum, frp_max, brightness_max, latest_ms, severity FROM h ORDER BY severity DESC, n DESC, cell_x, cell_y LIMIT 120""")
def agg02_hotspot_grid(spark, sf):
    s = signals(spark, sf)
    points = s.select((F.col("lat") / 12).alias("lat"), (F.col("lng") / 12).alias("lng"), (F.col("value") / 10).alias("frp"), F.col("severity").alias("brightness"), F.col("occurred_ms").alias("at_ms"))
    return feed.hotspot_grid(points).withColumns({c: R6(F.col(c)) for c in ("lat", "lng", "frp_sum")})


@query(f"""WITH {TRACKS_SQL}, c AS (SELECT floor(lat / 1e1 / 2e0) * 2 AS cell_lat, floor(lng / 1e1 / 2e0) * 2 AS cell_lng, count(*) AS n, avg(ord % 9) AS mean_nac FROM tracks WHERE ord % 9 <= 4 AND NOT on_ground GROUP BY 1, 2)
  SELECT cell_lat, cell_lng, n, {r6('mean_nac')} AS mean_nac, CAST(floor((1 - mean_nac / 4) * 100 + 0.5) AS INTEGER) AS severity FROM c WHERE n >= 3""")
def agg03_jamming_grid(spark, sf):
    return feed.jamming_grid(tracks(spark, sf).withColumns({"nac_p": F.col("ord") % 9, "lat": F.col("lat") / 10, "lng": F.col("lng") / 10})).withColumns({"mean_nac": R6(F.col("mean_nac"))})


@query("SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS newest, min_by(event_type, event_id) AS oldest FROM events GROUP BY user_id")
def agg04_newest_oldest(spark, sf):
    return feed.newest_and_oldest(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query(f"""WITH c AS {places_sql('customer', 'c_custkey % 300')}, g AS (SELECT CAST(floor(lat * 1000 + 0.5) AS BIGINT) AS cell_lat, CAST(floor(lng * 1000 + 0.5) AS BIGINT) AS cell_lng, count(*) AS n, count(DISTINCT c_mktsegment) AS providers FROM c GROUP BY 1, 2)
  SELECT *, n - 1 AS suspected FROM g WHERE n > 1 AND providers > 1""")
def agg08_duplicate_cells(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 300)
    return feed.duplicate_cells(c.withColumn("lat", key_lat(F.col("k") * 31 + 7)).withColumn("lng", key_lng(F.col("k") * 17 + 3)), "c_mktsegment")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS n FROM events) WHERE n = 1")
def jn16_keep_first(spark, sf):
    return feed.keep_first(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", "event_id", "event_type")


@query(f"""WITH {SIGNALS_SQL} SELECT source, url_key, max_by(id, (occurred_ms, ord)) AS id, max(occurred_ms) AS occurred_ms FROM signals GROUP BY source, url_key""".replace("max_by(id, (occurred_ms, ord))", "arg_max(id, occurred_ms::HUGEINT * 10000000 + ord)"))
def fus24_report_dedup(spark, sf):
    s = signals(spark, sf).select("source", "url_key", "occurred_ms", "ord", "id")
    return feed.keep_latest(s, ["source", "url_key"], ["occurred_ms", "ord"]).drop("ord")


@query(f"""WITH {SIGNALS_SQL}, p AS (SELECT ord AS change_sequence, id FROM signals WHERE ord > 500 AND ord <= 2000 ORDER BY ord LIMIT 301), q AS (SELECT *, row_number() OVER (ORDER BY change_sequence) AS n, count(*) OVER () > 300 AS has_more FROM p)
  SELECT change_sequence, id, has_more, max(change_sequence) OVER () AS next_cursor FROM q WHERE n <= 300""")
def srt02_replay_page(spark, sf):
    return feed.page_after(signals(spark, sf).select(F.col("ord").alias("change_sequence"), "id"), "change_sequence", 500, 2000, 300)


@query(f"""WITH {SIGNALS_SQL} SELECT id, severity, occurred_ms FROM signals WHERE ord > 100 ORDER BY ord LIMIT 250""")
def srt01_delta_page(spark, sf):
    return signals(spark, sf).where("ord > 100").orderBy("ord").limit(250).select("id", "severity", "occurred_ms")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS status_rank FROM customer GROUP BY 1, 2 ORDER BY n DESC, c_nationkey, c_mktsegment LIMIT 40")
def srt03_stable_sort(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("status_rank", F.rank().over(Window.orderBy(F.desc("n")))).orderBy(F.desc("n"), "c_nationkey", "c_mktsegment").limit(40)


@query(f"""WITH c AS (SELECT c_custkey, CAST(floor((lng + 180) / 3e0) AS BIGINT) AS cell_x, CAST(floor((lat + 90) / 3e0) AS BIGINT) AS cell_y FROM {places_sql('customer', 'c_custkey')})
  SELECT c_custkey, cell_x, cell_y, depth FROM (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY c_custkey) AS depth FROM c) ORDER BY depth, cell_x, cell_y LIMIT 100""")
def win17_spatial_sample(spark, sf):
    return feed.spatial_round_robin(places(spark, sf, "customer", "c_custkey"), "c_custkey").select("c_custkey", "cell_x", "cell_y", "depth")


@query("SELECT event_id, value FROM events WHERE event_id % CAST(ceil((SELECT count(*) FROM events) / 2000e0) AS BIGINT) = 0")
def src22_systematic_sample(spark, sf):
    return feed.systematic_sample(table(spark, sf, "events"), "event_id", 2000).select("event_id", "value")


# Geometry

HAV = "CASE WHEN {a}lat IS NOT NULL AND {b}lat IS NOT NULL THEN 2 * 6371 * asin(least(1e0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))) END"
S, C = places_sql("supplier", "s_suppkey"), places_sql("customer", "c_custkey")


#: Parts of each nation's places of customers, which all places of its suppliers meet one by one, tasks that share the parts, and most keys of a row.
NATION_PARTS, PAIR_TASKS, PLACE_KEYS = 64, 192, 256


def _standing(frame, key, nation):
    """A row for the keys of a nation that stand at a place, ``PLACE_KEYS`` at most."""
    by = [nation, "lat", "lng"]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return frame.withColumn("nth", F.floor((nth - 1) / PLACE_KEYS)).groupBy(*by, "nth").agg(F.array_sort(F.collect_list(key)).alias(key)).withColumnRenamed(nation, "nation")


def _pairs(spark, sf):
    """Suppliers and customers of the same nation by place: what a pair of places has is worked out once, for lists of keys.

    Few and small files would leave all pairs to a task or two.
    """
    s = _standing(places(spark, sf, "supplier", "s_suppkey"), "s_suppkey", "s_nationkey").drop("nth").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(NATION_PARTS - 1))))
    c = _standing(places(spark, sf, "customer", "c_custkey"), "c_custkey", "c_nationkey")
    c = c.select("nation", "c_custkey", F.pmod(F.hash("lat", "lng", "nth"), F.lit(NATION_PARTS)).alias("part"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return s.repartition(PAIR_TASKS, "nation", "part").hint("merge").join(c.repartition(PAIR_TASKS, "nation", "part"), ["nation", "part"])


def _each(pairs, **said):
    """A row for every two keys, those of two places one after another, so that what they share takes little room."""
    each = pairs.select("s_suppkey", "c_custkey", *[c.alias(name) for name, c in said.items()])
    return each.withColumn("s_suppkey", F.explode("s_suppkey")).withColumn("c_custkey", F.explode("c_custkey"))


PAIRS_SQL = f"pairs AS (SELECT s_suppkey, c_custkey, s.lat AS alat, s.lng AS alng, c.lat AS blat, c.lng AS blng FROM {S} s JOIN {C} c ON s_nationkey = c_nationkey)"
ARGS = lambda: (F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))


@query(f"WITH {PAIRS_SQL} SELECT s_suppkey, c_custkey, {r6(HAV.format(a='a', b='b'))} AS km FROM pairs")
def sca01_haversine(spark, sf):
    return _each(_pairs(spark, sf), km=R6(geo.haversine_km(*ARGS())))


BEAR = "((degrees(atan2(sin(radians(blng - alng)) * cos(radians(blat)), cos(radians(alat)) * sin(radians(blat)) - sin(radians(alat)) * cos(radians(blat)) * cos(radians(blng - alng)))) + 360) % 360)"


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT *, {BEAR} AS course FROM pairs)
  SELECT s_suppkey, c_custkey, {r6('course')} AS course, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor(course / 22.5e0 + 0.5) AS BIGINT) % 16 + 1] AS compass,
  {r6('degrees(asin(least(1e0, greatest(-1e0, sin(radians(alat)) * cos(500 / 6371e0) + cos(radians(alat)) * sin(500 / 6371e0) * cos(radians(course))))))')} AS to_lat FROM b""")
def sca02_bearing_destination(spark, sf):
    course = geo.bearing_deg(*ARGS())
    p = _pairs(spark, sf).withColumn("course", course)
    there = geo.destination(F.col("lat"), F.col("lng"), F.col("course"), F.lit(500.0))
    return _each(p, course=R6(F.col("course")), compass=geo.compass(F.col("course")), to_lat=R6(there["lat"]))


@query(f"""WITH r AS (SELECT r_regionkey, unnest([{{'i': 0, 'x': 0e0, 'y': 0e0}}, {{'i': 1, 'x': 10e0 + r_regionkey, 'y': 0e0}}, {{'i': 2, 'x': 10e0 + r_regionkey, 'y': 5e0 + r_regionkey}}, {{'i': 3, 'x': 5e0, 'y': 12e0}}, {{'i': 4, 'x': 0e0, 'y': 5e0 + r_regionkey}}]) AS p FROM region),
  e AS (SELECT a.r_regionkey, a.p.x AS alng, a.p.y AS alat, b.p.x AS blng, b.p.y AS blat FROM r a JOIN r b ON a.r_regionkey = b.r_regionkey AND b.p.i = (a.p.i + 1) % 5)
  SELECT r_regionkey, {r6('abs(sum(radians(blng - alng) * (2 + sin(radians(alat)) + sin(radians(blat)))) * 6371 * 6371 / 2)')} AS km2, {r6('sum(' + HAV.format(a='a', b='b') + ')')} AS perimeter_km FROM e GROUP BY r_regionkey""")
def sca03_polygon_area(spark, sf):
    k = F.col("r_regionkey")
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    p = lambda x, y: F.struct(number(x).alias("lng"), number(y).alias("lat"))
    ring = F.array(p(0, 0), p(10 + k, 0), p(10 + k, 5 + k), p(5, 12), p(0, 5 + k))
    r = table(spark, sf, "region").withColumn("ring", ring)
    return r.select("r_regionkey", R6(geo.ring_area_km2(F.col("ring"))).alias("km2"), R6(geo.ring_perimeter_km(F.col("ring"))).alias("perimeter_km"))


@query(f"""WITH s AS {S} SELECT s_suppkey, 65 AS points, {r6('min(' + HAV.format(a='a', b='b') + ')')} AS least_km, {r6('max(' + HAV.format(a='a', b='b') + ')')} AS most_km FROM (
  SELECT s_suppkey, lat AS alat, lng AS alng, degrees(asin(least(1e0, greatest(-1e0, sin(radians(lat)) * cos(100 / 6371e0) + cos(radians(lat)) * sin(100 / 6371e0) * cos(radians(i * 5.625e0)))))) AS blat,
    degrees(radians(lng) + atan2(sin(radians(i * 5.625e0)) * sin(100 / 6371e0) * cos(radians(lat)), cos(100 / 6371e0) - sin(radians(lat)) * (sin(radians(lat)) * cos(100 / 6371e0) + cos(radians(lat)) * sin(100 / 6371e0) * cos(radians(i * 5.625e0))))) AS blng
  FROM s, range(64) t(i)) GROUP BY s_suppkey""")
def sca04_circle(spark, sf):
    s = places(spark, sf, "supplier", "s_suppkey").withColumn("ring", geo.circle_ring(F.col("lat"), F.col("lng"), F.lit(100.0)))
    km = F.transform("ring", lambda p: geo.haversine_km(F.col("lat"), F.col("lng"), p["lat"], p["lng"]))
    return s.select("s_suppkey", F.size("ring").alias("points"), R6(F.array_min(km)).alias("least_km"), R6(F.array_max(km)).alias("most_km"))


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT s_suppkey, c_custkey, {HAV.format(a='a', b='b')} AS km FROM pairs)
  SELECT s_suppkey, c_custkey, CASE WHEN km < 1 THEN CAST(floor(km * 1000 + 0.5) AS BIGINT) || ' m' WHEN km < 100 THEN format('{{:.1f}} km', km) ELSE format('{{:,}} km', CAST(floor(km + 0.5) AS BIGINT)) END AS said FROM k""")
def sca11_format_distance(spark, sf):
    return _each(_pairs(spark, sf), said=geo.format_distance(geo.haversine_km(*ARGS())))


@query(f"""SELECT s_suppkey, {r6("cos(radians(lat)) * 2 * pi() * 6378137 / 256 / pow(2, 7)")} AS metres, {r6("(lng * 3 + 180) - 360 * floor((lng * 3 + 180) / 360) - 180")} AS wrapped, {r6("0.5 * 111.32 * 1.5 * 111.32 * cos(radians(lat + 0.25))")} AS km2 FROM {S}""")
def sca34_map_scale(spark, sf):
    lat, lng = F.col("lat"), F.col("lng")
    return places(spark, sf, "supplier", "s_suppkey").select(
        "s_suppkey", R6(geo.mercator_metres_per_pixel(lat, F.lit(7.0))).alias("metres"), R6(geo.wrap_longitude(lng * 3)).alias("wrapped"),
        R6(geo.box_area_km2(lat, lat + 0.5, lng, lng + 1.5)).alias("km2"),
    )


# Spatial joins

CENTRES = f"(SELECT s_suppkey, lat AS c_lat, lng AS c_lng FROM {S})"
E_SQL = "(SELECT event_id, event_type, value, (event_id * 7919) % 18000 / 1e2 - 90 AS lat, (event_id * 104729) % 36000 / 1e2 - 180 AS lng FROM events)"


def _centres(spark, sf):
    return places(spark, sf, "supplier", "s_suppkey").select("s_suppkey", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))


def _points(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value", key_lat(F.col("event_id")).alias("lat"), key_lng(F.col("event_id")).alias("lng"))


CHAV = HAV.format(a="", b="c_")


@query(f"SELECT event_id, s_suppkey, {r6(CHAV)} AS km FROM {E_SQL} e JOIN {CENTRES} c ON {CHAV} <= 150")
def jn08_radius_join(spark, sf):
    return spatial.radius_join(_points(spark, sf), _centres(spark, sf), 150.0).select("event_id", "s_suppkey", R6(F.col("km")).alias("km"))


@query(f"""SELECT s_suppkey, coalesce('SEISMIC RISK (M' || max(CASE WHEN event_id IS NOT NULL THEN floor(value / 50) END)::BIGINT || ')', 'NORMAL') AS status FROM {CENTRES} c LEFT JOIN {E_SQL} e ON {CHAV} <= 150 AND event_type = 'purchase' GROUP BY s_suppkey""")
def jn09_facility_quakes(spark, sf):
    quakes = _points(spark, sf).where("event_type = 'purchase'")
    near = spatial.radius_join(quakes, _centres(spark, sf), 150.0).groupBy("s_suppkey").agg(F.max(F.floor(F.col("value") / 50)).alias("mag"))
    return _centres(spark, sf).join(near, "s_suppkey", "left").select("s_suppkey", F.coalesce(F.concat(F.lit("SEISMIC RISK (M"), F.col("mag").cast("string"), F.lit(")")), F.lit("NORMAL")).alias("status"))


@query(f"""WITH n AS (SELECT s_suppkey, bool_or(event_type = 'purchase' AND {CHAV} <= 150) AS quake, bool_or(event_type = 'click' AND {CHAV} <= 50) AS fire, bool_or(event_type = 'signup' AND {CHAV} <= 100) AS incident FROM {CENTRES} c JOIN {E_SQL} e ON {CHAV} <= 150 GROUP BY s_suppkey)
  SELECT s_suppkey, CASE WHEN quake OR incident THEN 'CRITICAL' WHEN fire THEN 'HIGH' ELSE 'NORMAL' END AS threat FROM {CENTRES} c LEFT JOIN n USING (s_suppkey)""")
def jn10_supplier_overlay(spark, sf):
    near = spatial.radius_join(_points(spark, sf), _centres(spark, sf), 150.0)
    kind, km = F.col("event_type"), F.col("km")
    flags = near.groupBy("s_suppkey").agg(
        F.bool_or(kind == "purchase").alias("quake"), F.bool_or((kind == "click") & (km <= 50)).alias("fire"), F.bool_or((kind == "signup") & (km <= 100)).alias("incident")
    )
    threat = F.when(F.col("quake") | F.col("incident"), "CRITICAL").when(F.col("fire"), "HIGH").otherwise("NORMAL")
    return _centres(spark, sf).join(flags, "s_suppkey", "left").select("s_suppkey", threat.alias("threat"))


@query(f"""SELECT event_id, s_suppkey, nth FROM (SELECT event_id, s_suppkey, row_number() OVER (PARTITION BY event_id ORDER BY {CHAV}, s_suppkey) AS nth FROM {E_SQL} e JOIN {CENTRES} c ON {CHAV} <= 400) WHERE nth <= 3""")
def jn11_knn(spark, sf):
    return spatial.nearest(_points(spark, sf), "event_id", _centres(spark, sf), "s_suppkey", 400.0, 3).select("event_id", "s_suppkey", "nth")


@query(f"""SELECT event_id, arg_min(s_suppkey, {CHAV}) AS s_suppkey FROM {E_SQL} e JOIN {CENTRES} c ON {CHAV} <= 125 GROUP BY event_id""")
def jn12_nearest(spark, sf):
    return spatial.nearest(_points(spark, sf), "event_id", _centres(spark, sf), "s_suppkey", 125.0).select("event_id", "s_suppkey")


FLAT = "sqrt(pow(lat - c_lat, 2) + pow(lng - c_lng, 2)) * 111.32e0"


@query(f"""WITH n AS (SELECT s_suppkey, count(*) AS nearby, count(*) FILTER (value < 20) AS waiting FROM {CENTRES} c JOIN {E_SQL} e ON {FLAT} <= 300 GROUP BY s_suppkey)
  SELECT s_suppkey, coalesce(nearby, 0) AS nearby, coalesce(waiting, 0) AS waiting, CASE WHEN waiting > 5 THEN 'SEVERE' WHEN waiting > 2 THEN 'CONGESTED' ELSE 'NORMAL' END AS status FROM {CENTRES} c LEFT JOIN n USING (s_suppkey)""")
def agg09_port_congestion(spark, sf):
    # Events of one place are counted before they meet the ports around it.
    held = _points(spark, sf).groupBy("lat", "lng").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 20).alias("w"))
    near = spatial.radius_join(held, _centres(spark, sf), 300.0, flat=True).groupBy("s_suppkey").agg(F.sum("n").alias("nearby"), F.sum("w").alias("waiting"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(F.col("waiting") > 5, "SEVERE").when(F.col("waiting") > 2, "CONGESTED").otherwise("NORMAL")
    return _centres(spark, sf).join(near, "s_suppkey", "left").select("s_suppkey", zero("nearby").alias("nearby"), zero("waiting").alias("waiting"), status.alias("status"))


def chokepoint_risk_sql(km: int) -> str:
    return f"""WITH n AS (SELECT s_suppkey, count(*) AS n FROM {CENTRES} c JOIN {E_SQL} e ON {FLAT} <= {km} GROUP BY s_suppkey)
  SELECT s_suppkey, CASE WHEN n > 50 THEN 'critical' WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'elevated' ELSE 'low' END AS risk FROM {CENTRES} c LEFT JOIN n USING (s_suppkey)"""


def chokepoint_risk(spark, sf, km):
    held = _points(spark, sf).groupBy("lat", "lng").agg(F.count("*").alias("held"))
    n = spatial.radius_join(held, _centres(spark, sf), float(km), flat=True).groupBy("s_suppkey").agg(F.sum("held").alias("n"))
    risk = F.when(F.col("n") > 50, "critical").when(F.col("n") > 20, "high").when(F.col("n") > 5, "elevated").otherwise("low")
    return _centres(spark, sf).join(n, "s_suppkey", "left").select("s_suppkey", risk.alias("risk"))


@query(chokepoint_risk_sql(600))
def agg10_chokepoint_risk(spark, sf):
    return chokepoint_risk(spark, sf, 600)


AREAS = {"ell": [(-40, -30), (40, -30), (40, 0), (0, 0), (0, 40), (-40, 40)], "tri": [(60, 0), (150, 10), (100, 70)], "box": [(-170, -80), (-100, -80), (-100, -20), (-170, -20)]}
_EDGES = ", ".join(f"('{n}', {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for n, r in AREAS.items() for a, b in zip(r, r[1:] + r[:1]))


@query(f"""WITH e(area, x1, y1, x2, y2) AS (VALUES {_EDGES}), c AS {C}
  SELECT area, c_custkey FROM (SELECT area, c_custkey, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS n FROM c, e GROUP BY area, c_custkey) WHERE n % 2 = 1""")
def jn07_point_in_polygon(spark, sf):
    areas = spark.createDataFrame([(n, [{"lng": float(x), "lat": float(y)} for x, y in r]) for n, r in AREAS.items()], "area string, ring array<struct<lng:double,lat:double>>")
    return spatial.polygon_join(places(spark, sf, "customer", "c_custkey"), areas).select("area", "c_custkey")


ZONES = [("levant", 29.0, 38.0, 33.0, 43.0, ["tion"]), ("horn", -5.0, 20.0, 30.0, 55.0, ["worthless", "reeau"]), ("baltic", 50.0, 66.0, 10.0, 32.0, ["keit"])]
_ZONES = ", ".join(f"('{n}', {a}, {b}, {c}, {d}, {x})" for n, a, b, c, d, x in ZONES)
_DOCS = "(SELECT doc_id, text AS title, (doc_id * 7919) % 18000 / 1e2 - 90 AS lat, (doc_id * 104729) % 36000 / 1e2 - 180 AS lng FROM documents)"


@query(f"""WITH z(zone, a, b, c, d, al) AS (VALUES {_ZONES}) SELECT zone, doc_id FROM {_DOCS} x, z WHERE (lat BETWEEN a AND b AND lng BETWEEN c AND d) OR len(list_filter(al, lambda w: contains(lower(title), w))) > 0""")
def jn06_zone_join(spark, sf):
    zones = spark.createDataFrame(ZONES, "zone string, min_lat double, max_lat double, min_lng double, max_lng double, aliases array<string>")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), key_lat(F.col("doc_id")).alias("lat"), key_lng(F.col("doc_id")).alias("lng"))
    return spatial.zone_join(d, zones, "title").select("zone", "doc_id")


@query(f"""WITH z(zone, a, b, c, d, al) AS (VALUES {_ZONES}), m AS (SELECT zone, doc_id FROM {_DOCS} x, z WHERE (lat BETWEEN a AND b AND lng BETWEEN c AND d) OR len(list_filter(al, lambda w: contains(lower(title), w))) > 0)
  SELECT zone, count(*) AS matches, list_slice(list(doc_id ORDER BY doc_id), 1, 20) AS first_ids, max(doc_id) AS latest FROM m GROUP BY zone""")
def agg12_zone_rollup(spark, sf):
    m = jn06_zone_join(spark, sf)
    # Each partition keeps its own first twenty of a zone before they meet.
    nth = m.withColumn("n", F.row_number().over(Window.partitionBy("zone").orderBy("doc_id"))).where("n <= 20")
    first = nth.groupBy("zone").agg(F.array_sort(F.collect_list("doc_id")).alias("first_ids"))
    return m.groupBy("zone").agg(F.count("*").alias("matches"), F.max("doc_id").alias("latest")).join(first, "zone")
