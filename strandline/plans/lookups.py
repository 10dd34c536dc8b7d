"""Classifier, lookup and translator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import geo, lookups, text
from strandline.operators import feed, reconcile
from strandline.plans.feed import R6, chokepoint_risk, chokepoint_risk_sql, r6
from strandline.plans.reconcile import _LEGS, _hav, _legs
from strandline.sources import parsers
from strandline.sources.adapters import SIGNALS_SQL, places, places_sql, signals, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


C, S = places_sql("customer", "c_custkey"), places_sql("supplier", "s_suppkey")
_BOXES = " ".join(f"WHEN lat BETWEEN {s} AND {n} AND lng BETWEEN {w} AND {e} THEN '{name}'" for name, s, n, w, e in lookups.MACRO_REGIONS)


@query(f"SELECT c_custkey, CASE {_BOXES} ELSE 'other' END AS region FROM {C}")
def sca24_macro_region(spark, sf):
    return places(spark, sf, "customer", "c_custkey").select("c_custkey", lookups.macro_region(F.col("lat"), F.col("lng")).alias("region"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'Turkey' WHEN 2 THEN 'Germany' END AS country FROM customer")
def sca30_registration(spark, sf):
    k = F.col("c_custkey")
    reg = F.concat(F.when(k % 4 == 0, "N1").when(k % 4 == 1, "TC-").when(k % 4 == 2, "D-A").otherwise("ZZ"), k.cast("string"))
    return table(spark, sf, "customer").select("c_custkey", lookups.registration_country(reg).alias("country"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'domain' ELSE 'username' END AS kind, 64500 + c_custkey AS asn, 'Net ' || c_custkey AS name FROM customer")
def sca18_asset_type(spark, sf):
    k = F.col("c_custkey")
    q = F.when(k % 4 == 0, "a@b.example").when(k % 4 == 1, "+1 (20) 555-1000").when(k % 4 == 2, "a.b-c.example").otherwise("some_name")
    a = lookups.as_number(F.concat(F.lit("AS"), (k + 64500).cast("string"), F.lit(" Net "), k.cast("string")))
    return table(spark, sf, "customer").select("c_custkey", lookups.asset_type(q).alias("kind"), a["asn"].alias("asn"), a["name"].alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'country' WHEN 1 THEN 'region' WHEN 2 THEN 'city' WHEN 3 THEN 'street' WHEN 4 THEN 'poi' ELSE 'place' END AS kind FROM part")
def sca31_place_kind(spark, sf):
    n = F.col("p_partkey") % 6
    key = F.when(n < 3, "place").when(n == 3, "highway").when(n == 4, "amenity")
    value = F.when(n == 0, "country").when(n == 1, "county").when(n == 2, "village").otherwise("x")
    return table(spark, sf, "part").select("p_partkey", lookups.place_kind(key, value).alias("kind"))


@query(f"SELECT event_id, {r6('(sqrt(least(36000e0, greatest(150e0, value * 90))) - sqrt(150e0)) / (sqrt(36000e0) - sqrt(150e0))')} AS share, {r6('1440 / (value / 30 + 0.5)')} AS minutes FROM events")
def sca10_display_share(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", R6(lookups.display_share(v * 90)).alias("share"), R6(geo.orbital_period_minutes(v / 30 + 0.5)).alias("minutes"))


@query(f"SELECT event_id, {r6(_hav('1', '') + ' / CASE WHEN event_id % 500 > 50 THEN event_id % 500 * 1.852e0 ELSE 800 END')} AS done_h, {r6(_hav('', '2') + ' / CASE WHEN event_id % 500 > 50 THEN event_id % 500 * 1.852e0 ELSE 800 END')} AS left_h, {r6('CASE WHEN ' + _hav('1', '2') + ' > 0 THEN least(1e0, ' + _hav('1', '') + ' / ' + _hav('1', '2') + ') ELSE 0 END')} AS progress FROM {_LEGS}")
def sca40_leg_clock(spark, sf):
    p = [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2", "lat", "lng")]
    g = _legs(spark, sf).withColumn("c", lookups.leg_clock(*p, F.col("event_id") % 500))
    return g.select("event_id", *[R6(F.col(f"c.{n}")).alias(n) for n in ("done_h", "left_h", "progress")])


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS safe FROM pages")
def sca33_safe_url(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", lookups.http_url(u).alias("safe"))


@query("SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END AS shapes FROM region")
def sca39_stored_shapes(spark, sf):
    good = '[{"id":"a","name":"n","geojson":{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}},{"id":"b","geojson":{}}]'
    raw = F.when(F.col("r_regionkey") % 3 == 0, good).when(F.col("r_regionkey") % 3 == 1, "not json").otherwise('[{"id":"c","name":"n","geojson":{"geometry":{"type":"Point","coordinates":[1,2]}}}]')
    return table(spark, sf, "region").select("r_regionkey", F.size(lookups.stored_shapes(raw)).alias("shapes"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'hls' WHEN 1 THEN 'snapshot' WHEN 2 THEN 'video' ELSE 'unknown' END AS kind, CASE s_suppkey % 4 WHEN 1 THEN 'f.jpg' END AS still FROM supplier")
def sca41_feed_kind(spark, sf):
    n = F.col("s_suppkey") % 4
    kind, own, stream = F.when(n == 0, "HLS").when(n == 1, "jpg").when(n == 2, "mp4").otherwise(""), F.when(n == 1, "f.jpg"), F.when(n == 2, "s.mp4").when(n == 0, "s.m3u8")
    none = F.lit(None).cast("string")
    return table(spark, sf, "supplier").select("s_suppkey", lookups.feed_kind(kind, own, stream, none).alias("kind"), lookups.snapshot_url(kind, own, stream).alias("still"))


@query(f"""WITH {SIGNALS_SQL} SELECT 'AIR' AS domain, 'air-' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'ELEVATED' ELSE 'NONE' END AS threat FROM customer UNION ALL SELECT 'SEISMIC', id, CASE WHEN severity >= 60 THEN 'CRITICAL' WHEN severity >= 50 THEN 'HIGH' ELSE 'LOW' END FROM signals WHERE category = 'earthquake' UNION ALL SELECT 'SEA', 'sea-' || s_suppkey, 'NONE' FROM supplier""")
def src26_entities(spark, sf):
    k, s = F.col("c_custkey"), F.col("severity")
    air = table(spark, sf, "customer").select(F.lit("AIR").alias("domain"), F.concat(F.lit("air-"), k.cast("string")).alias("id"), F.when(k % 5 == 0, "ELEVATED").otherwise("NONE").alias("threat"))
    quakes = signals(spark, sf).where("category = 'earthquake'").select(F.lit("SEISMIC").alias("domain"), "id", F.when(s >= 60, "CRITICAL").when(s >= 50, "HIGH").otherwise("LOW").alias("threat"))
    sea = table(spark, sf, "supplier").select(F.lit("SEA").alias("domain"), F.concat(F.lit("sea-"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("NONE").alias("threat"))
    return air.unionByName(quakes).unionByName(sea)


@query(f"""WITH {SIGNALS_SQL} SELECT 'storm' AS kind, id, CAST(NULL AS VARCHAR) AS area FROM signals WHERE category = 'weather' UNION ALL SELECT 'fire', id, NULL FROM signals WHERE category = 'wildfire' UNION ALL SELECT 'warning', 'w' || s_suppkey, s_name FROM supplier""")
def src23_weather_union(spark, sf):
    s = signals(spark, sf)
    part = lambda c, kind: s.where(F.col("category") == c).select(F.lit(kind).alias("kind"), "id")
    warn = table(spark, sf, "supplier").select(F.lit("warning").alias("kind"), F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("area"))
    return part("weather", "storm").unionByName(part("wildfire", "fire")).unionByName(warn, allowMissingColumns=True)


@query(f"""WITH {SIGNALS_SQL} SELECT url_key, max(ord) AS sequence, arg_max(severity, ord) AS severity FROM signals GROUP BY url_key""")
def str07_client_sync(spark, sf):
    s = signals(spark, sf).select("url_key", F.col("ord").alias("sequence"), "severity")
    have, pages = s.where("sequence < 5000"), s.where("sequence >= 5000")
    return feed.keep_latest(have.unionByName(pages), ["url_key"], ["sequence"])


@query(f"""WITH {SIGNALS_SQL}, m AS (SELECT max(occurred_ms) AS top FROM signals), p AS (SELECT source, count(*) AS n FROM signals, m WHERE occurred_ms > top - 172800000 GROUP BY source) SELECT source, n FROM p""")
def str03_retention(spark, sf):
    s = signals(spark, sf)
    top = s.agg(F.max("occurred_ms").alias("top")).first().top or 0
    return s.where(F.col("occurred_ms") > top - 172_800_000).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT o_orderkey AS id, 'CVE-' || (2000 + o_orderkey % 25) || '-' || (1000 + o_orderkey) AS cve, CASE WHEN o_orderkey % 3 = 0 THEN 9.8e0 END AS v31, CASE WHEN o_orderkey % 2 = 0 THEN 7.5e0 END AS v30, 5e0 AS v2 FROM orders) SELECT cve, coalesce(v31, v30, v2) AS score FROM v WHERE coalesce(v31, v30, v2) >= 7""")
def src18_vulnerabilities(spark, sf):
    k = F.col("o_orderkey")
    cve = F.concat_ws("-", F.lit("CVE"), (2000 + k % 25).cast("string"), (1000 + k).cast("string"))
    score = F.coalesce(F.when(k % 3 == 0, 9.8), F.when(k % 2 == 0, 7.5), F.lit(5.0))
    return table(spark, sf, "orders").select(cve.alias("cve"), score.alias("score")).where("score >= 7")


@query(f"SELECT s_suppkey, lower(s_name) AS hex, {r6('lat')} AS lat, CAST(floor(s_suppkey * 10 * 3.28084e0 + 0.5) AS BIGINT) AS alt_ft, s_suppkey % 4 = 0 AS on_ground FROM {S} WHERE s_suppkey % 7 > 0")
def src20_states(spark, sf):
    k = F.col("s_suppkey")
    s = places(spark, sf, "supplier", "s_suppkey")
    vector = F.array(
        F.col("s_name"), F.lit(" CALL "), k.cast("string"), F.lit("0"), F.lit("0"), F.when(k % 7 > 0, F.col("lng").cast("string")), F.col("lat").cast("string"), (k * 10).cast("string"),
        F.when(k % 4 == 0, "true").otherwise("false"), F.lit("100"), F.lit("90"),
    )
    p = parsers.position_states(s.select(F.to_json(vector).alias("raw")), "raw")
    return p.select(F.col("country").cast("long").alias("s_suppkey"), "hex", R6(F.col("lat")).alias("lat"), "alt_ft", "on_ground")


@query("SELECT 'ext-feed-' || user_id AS entity_id, max(event_id) AS ord FROM events WHERE event_id % 10 > 0 GROUP BY 1")
def src25_entity_ingest(spark, sf):
    e = F.col("event_id")
    pushed = table(spark, sf, "events").select(e.alias("ord"), F.col("user_id").cast("string").alias("id"), F.when(e % 10 == 0, 95.0).otherwise(10.0).alias("lat"), F.lit(5.0).alias("lng"))
    return parsers.accepted_entities(pushed, "feed").where("accepted").select("entity_id", "ord")


_B = "[^\\p{L}\\p{N}]"
_KEYS = lambda keys: "|".join(k.replace(".", "\\.").replace("'", "''") + ("[а-яё]{0,3}" if any("а" <= c <= "ё" for c in k) else "") for k in keys)
_WHERE = " ".join(f"WHEN regexp_matches(low, '(?:^|{_B})(?:{_KEYS(keys)})(?:{_B}|$)') THEN '{label.replace(chr(39), chr(39) * 2)}'" for keys, label, *_ in text.PLACES)
_SAID = ("Gaza City and London", "в Киеве и Москве", "Kievan days", "near the Strait of Hormuz.", "Sana'a talks", "nothing here", "ПАРИЖ", "washington d.c.")
_SAID_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID) + "]"


@query(f"SELECT event_id, CASE {_WHERE} END AS label FROM (SELECT event_id, lower({_SAID_SQL}[event_id % 8 + 1]) AS low FROM events)")
def fus21_locate(spark, sf):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select("event_id", text.locate(said)["label"].alias("label"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'eonet:' || event_id WHEN 1 THEN 'firms:viirs:1:' || event_id || ':2024-01-01' WHEN 2 THEN 'old' END AS upstream_id FROM events")
def fus06_provider_identity(spark, sf):
    e = F.col("event_id")
    own = F.when(e % 4 == 0, F.concat(F.lit("eonet:"), e.cast("string"))).when(e % 4 == 1, F.concat(F.lit("firms:viirs:1:"), e.cast("string"), F.lit(":2024-01-01"))).otherwise(F.lit("cloudflare-outage:x:ye"))
    source = F.when(e % 4 == 0, "nasa-eonet").when(e % 4 == 1, "nasa-firms-viirs").otherwise("other")
    return table(spark, sf, "events").select("event_id", text.provider_identity(own, source, F.when(e % 4 == 2, "old")).alias("upstream_id"))


@query("""WITH p AS (SELECT c_custkey AS event_id, CASE WHEN c_custkey % 2 = 0 THEN 'propose_split_for_review' ELSE 'manual_review' END AS action FROM customer), h AS (SELECT c_custkey AS e FROM customer WHERE c_custkey % 30 = 0 UNION SELECT c_custkey + 1 FROM customer WHERE c_custkey % 30 = 0)
  SELECT event_id, CASE WHEN e IS NOT NULL THEN 'manual_review' ELSE action END AS action, e IS NOT NULL AS held FROM p LEFT JOIN h ON e = event_id""")
def idr07_review_holds(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    plan = c.select(k.alias("event_id"), F.when(k % 2 == 0, "propose_split_for_review").otherwise("manual_review").alias("action"))
    return reconcile.review_holds(plan, c.where(k % 30 == 0).select(k.alias("left"), (k + 1).alias("right")))


_PARTS = "concat_ws(',', " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + ")"


@query(f"""WITH r AS (SELECT sha256('{{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}') AS h FROM customer)
  SELECT count(*) AS n, sha256({_PARTS}) AS checksum FROM r""")
def idr08_snapshot_checksum(spark, sf):
    return reconcile.snapshot_checksum(table(spark, sf, "customer"))


_STRAITS = ("Strait of Hormuz", "Suez Canal", "Panama Canal", "Bosporus", "Strait of Malacca")
_STRAIT_SQL = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_STRAITS)) + " END"
_ALERT_SQL = "CASE name " + " ".join(f"WHEN '{n}' THEN '{said}'" for n, said in reconcile.CHOKEPOINTS.items()) + " END"


@query(f"""WITH risks AS ({chokepoint_risk_sql(800)}), c AS (SELECT s_suppkey, {_STRAIT_SQL} AS name, upper(risk) AS risk FROM risks), a AS (SELECT *, {_ALERT_SQL} AS alert FROM c)
  SELECT s_suppkey, name, risk, alert FROM a WHERE risk IN ('HIGH', 'CRITICAL') AND alert IS NOT NULL""")
def rsk05_supply_alerts(spark, sf):
    """Alerts of the chokepoints whose risk, as the events around them give it, is high or critical."""
    name = F.element_at(F.array(*map(F.lit, _STRAITS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    risks = chokepoint_risk(spark, sf, 800).select("s_suppkey", name.alias("name"), F.upper("risk").alias("risk"))
    return reconcile.supply_alerts(risks)


@query()
def agg18_file_stats(spark, sf):
    return reconcile.file_stats(table(spark, sf, "orders"))
