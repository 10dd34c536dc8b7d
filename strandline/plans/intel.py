"""Wallet, coverage, market, graph and payload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import craft, net
from strandline.operators import intel
from strandline.plans.feed import R6, r6
from strandline.sources import parsers
from strandline.sources.adapters import NOW_MS, SIGNALS_SQL, key_lat, key_lng, signals, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def wallet_tx(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    j = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.col("o_orderstatus")
    return j.select(
        F.col("o_custkey").alias("wallet"), (F.col("l_suppkey") % 40).alias("counterparty"), F.when(status == "F", "in").when(status == "O", "out").otherwise("self").alias("direction"),
        F.floor("l_extendedprice").cast("double").alias("value"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"), (F.col("l_returnflag") == "R").alias("failed"),
    )


TX = """tx AS (SELECT o_custkey AS wallet, l_suppkey % 40 AS counterparty, CASE o_orderstatus WHEN 'F' THEN 'in' WHEN 'O' THEN 'out' ELSE 'self' END AS direction, floor(l_extendedprice) AS value,
  epoch_us(o_orderdate) // 1000 AS at_ms, l_returnflag = 'R' AS failed FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


@query(f"""WITH {TX}, g AS (SELECT wallet, counterparty, count(*) AS txs, sum(value) AS value, CASE WHEN bool_and(direction = 'in') THEN 'in' WHEN bool_and(direction = 'out') THEN 'out' ELSE 'both' END AS direction FROM tx GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY txs DESC, value DESC, counterparty) AS nth FROM g) WHERE nth <= 15""")
def agg05_counterparties(spark, sf):
    return intel.counterparties(wallet_tx(spark, sf))


ACT = f"""{TX}, act AS (SELECT wallet, count(*) AS txs, coalesce(sum(value) FILTER (direction = 'in'), 0) AS total_in, coalesce(sum(value) FILTER (direction = 'out'), 0) AS total_out, CAST(floor(({NOW_MS} - min(at_ms)) / 86400000) AS BIGINT) AS age_days,
  CAST(floor(({NOW_MS} - max(at_ms)) / 86400000) AS BIGINT) AS dormant_days, count(*) FILTER (failed) AS failed, count(DISTINCT counterparty) AS partners FROM tx GROUP BY wallet)"""


@query(f"WITH {ACT} SELECT wallet, txs, total_in, total_out, age_days, dormant_days, failed, partners FROM act")
def agg06_wallet_activity(spark, sf):
    return intel.wallet_activity(wallet_tx(spark, sf), NOW_MS).select("wallet", "txs", "total_in", "total_out", "age_days", "dormant_days", "failed", "partners")


@query(f"""WITH {ACT}, f AS (SELECT wallet, 100 AS w, true AS crit FROM act WHERE wallet % 97 = 0 UNION ALL SELECT wallet, 10, false FROM act WHERE age_days < 7 UNION ALL SELECT wallet, 5, false FROM act WHERE dormant_days > 365 AND age_days > 400
    UNION ALL SELECT wallet, 5, false FROM act WHERE txs > 10000 UNION ALL SELECT wallet, 20, false FROM act WHERE partners >= 12 AND txs <= 10000 UNION ALL SELECT wallet, 8, false FROM act WHERE failed >= 5
    UNION ALL SELECT wallet, 15, false FROM act WHERE total_in > 0 AND (total_in - total_out) / total_in < 0.01 AND txs > 5),
  s AS (SELECT wallet, least(100, coalesce(sum(w), 0)) AS s, coalesce(bool_or(crit), false) AS crit, greatest(count(w), 1) AS factors FROM act LEFT JOIN f USING (wallet) GROUP BY wallet)
  SELECT wallet, CAST(CASE WHEN crit THEN greatest(s, 95) ELSE s END AS BIGINT) AS score, CASE WHEN crit THEN 'critical' WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' WHEN s >= 15 THEN 'low' ELSE 'info' END AS level, factors FROM s""")
def rsk01_wallet_score(spark, sf):
    a = intel.wallet_activity(wallet_tx(spark, sf), NOW_MS)
    return intel.wallet_scores(intel.wallet_factors(a, F.col("wallet") % 97 == 0))


@query("""WITH p AS (SELECT p_partkey AS ord, lower(p_name) AS name, [lower(p_type), lower(p_brand), split_part(lower(p_name), ' ', 2)] AS al FROM part),
  r AS (SELECT ord, name, CASE WHEN name = 'ring' THEN 0 WHEN list_contains(al, 'ring') THEN 1 WHEN contains(name, 'ring') THEN 2 WHEN len(list_filter(al, lambda x: contains(x, 'ring'))) > 0 THEN 3 END AS rank FROM p) SELECT ord, name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, ord LIMIT 50""")
def jn14_ranked_search(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.lower("p_name").alias("name"), F.array(F.lower("p_type"), F.lower("p_brand"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2))).alias("al"))
    return intel.ranked_search(p, F.col("name"), F.col("al"), "ring", 50).select("ord", "name", "rank")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey % 1000 = s_suppkey AND c_nationkey = s_nationkey")
def jn13_exact_match(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("#", (F.col("s_suppkey")).cast("string"), F.col("s_nationkey").cast("string")).alias("key"))
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws("#", (F.col("c_custkey") % 1000).cast("string"), F.col("c_nationkey").cast("string")).alias("key"))
    return c.join(s, "key").select("c_custkey", "s_suppkey")


@query("""WITH r AS (SELECT r_name AS region, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 8500 AND c_nationkey % 6 <> 5), p AS (SELECT region, country, count(*) AS n FROM r GROUP BY ALL),
  w AS (SELECT r_name AS region, count(*) AS watched, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n BETWEEN 1 AND 4) AS weak, coalesce(sum(n), 0) AS target FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN p ON region = r_name AND country = n_name GROUP BY 1),
  t AS (SELECT region, sum(n) AS rows, count(*) AS countries FROM p GROUP BY 1)
  SELECT region, CAST(coalesce(rows, 0) AS BIGINT) AS rows, coalesce(countries, 0) AS countries, CASE WHEN coalesce(rows, 0) = 0 THEN 'gap' WHEN rows < 10 THEN 'sparse' WHEN rows < 100 THEN 'covered' ELSE 'dense' END AS band, watched, missing, weak,
    CAST(CASE WHEN missing + weak = 0 THEN 0 ELSE least(100, floor(CASE WHEN target = 0 THEN 40 WHEN target < 10 THEN 30 WHEN target < 50 THEN 15 WHEN target < 100 THEN 5 ELSE 0 END + missing / watched::DOUBLE * 50 + weak / watched::DOUBLE * 10 + 0.5)) END AS INTEGER) AS gap_score FROM w LEFT JOIN t USING (region)""")
def agg07_coverage(spark, sf):
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    watch = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("country"), "n_nationkey")
    rows = c.where("c_acctbal > 8500 AND c_nationkey % 6 <> 5").join(watch, F.col("c_nationkey") == F.col("n_nationkey")).select("region", "country")
    return intel.coverage(rows, watch.select("region", "country"))


def _cameras(spark, sf):
    """Every customer as a camera; some nations' are of no known country, of others only each 25th customer's country is known."""
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    k, m = F.col("c_custkey"), F.col("n_nationkey")
    j = c.join(n, F.col("c_nationkey") == m).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    country = F.when((m % 6 == 5) | ((m % 7 == 3) & (k % 25 != 0)), None).otherwise(F.col("n_name"))
    cameras = j.select(F.col("r_name").alias("region"), country.alias("country"), F.lower("c_mktsegment").alias("provider"), F.when(k % 3 == 0, "image").when(k % 3 == 1, "stream").otherwise("other").alias("feed"))
    watch = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("country"), (m % 3 + 1).alias("tier"))
    return cameras, watch


_CAMERAS = """c AS (SELECT r_name AS region, CASE WHEN n_nationkey % 6 = 5 OR (n_nationkey % 7 = 3 AND c_custkey % 25 <> 0) THEN NULL ELSE n_name END AS country, lower(c_mktsegment) AS provider, CASE c_custkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'stream' ELSE 'other' END AS feed
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), p AS (SELECT country, count(*) AS n FROM c WHERE country IS NOT NULL GROUP BY 1),
  w AS (SELECT r_name AS region, n_name AS country, n_nationkey % 3 + 1 AS tier, coalesce(n, 0) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN p ON country = n_name)"""
_SEGMENTS, _FEEDS = ["automobile", "building", "furniture", "household", "machinery"], ["image", "stream"]
_COUNTS = ", ".join([f"count(*) FILTER (provider = '{p}') AS provider_{p}" for p in _SEGMENTS] + [f"count(*) FILTER (feed = '{f}') AS feed_{f}" for f in _FEEDS])


@query(f"""WITH {_CAMERAS}, r AS (SELECT region, count(*) AS rows, count(DISTINCT country) AS countries, {_COUNTS} FROM c GROUP BY 1),
  g AS (SELECT region, count(*) AS watched, count(*) FILTER (n > 0) AS seen, count(*) FILTER (n = 0) AS m, count(*) FILTER (n BETWEEN 1 AND 4) AS k, array_to_string(list(country ORDER BY country) FILTER (n = 0), ',') AS missing,
    array_to_string(list(country ORDER BY country) FILTER (n BETWEEN 1 AND 4), ',') AS weak, min(tier) FILTER (n < 5) AS tier, sum(n) AS target FROM w GROUP BY 1),
  s AS (SELECT r.*, CASE WHEN rows < 10 THEN 'sparse' WHEN rows < 100 THEN 'covered' ELSE 'dense' END AS band, watched, seen, coalesce(missing, '') AS missing, coalesce(weak, '') AS weak, tier,
    CAST(CASE WHEN m + k = 0 THEN 0 ELSE least(100, floor(CASE WHEN target = 0 THEN 40 WHEN target < 10 THEN 30 WHEN target < 50 THEN 15 WHEN target < 100 THEN 5 ELSE 0 END + m / watched::DOUBLE * 50 + k / watched::DOUBLE * 10 + 0.5)) END AS INTEGER) AS gap_score FROM r JOIN g USING (region))
  SELECT *, CASE WHEN gap_score > 0 THEN row_number() OVER (PARTITION BY gap_score > 0 ORDER BY coalesce(tier, 99), gap_score DESC, rows, region) END AS place FROM s""")
def agg07_regions(spark, sf):
    """Regions by provider and feed, with what their watchlists miss, in order of priority."""
    cameras, watch = _cameras(spark, sf)
    found = intel.coverage_regions(cameras, watch, _SEGMENTS, _FEEDS)
    return found.withColumns({"missing": F.array_join("missing", ","), "weak": F.array_join("weak", ",")})


@query(f"""WITH {_CAMERAS}, s AS (SELECT country, tier, n AS rows, CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN 1 ELSE 2 END AS k FROM w)
  SELECT country, tier, rows, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'weak' ELSE 'covered' END AS status, row_number() OVER (ORDER BY tier, k, rows, country) AS place FROM s""")
def agg07_countries(spark, sf):
    cameras, watch = _cameras(spark, sf)
    return intel.coverage_countries(cameras, watch.select("country", "tier"))


_TYPES = [*craft.HELICOPTERS, *craft.MILITARY, *craft.AIRLINERS, *craft.JETS, "C172", "TWR", ""]
_SIGNS = [*[s + "12" for s in craft.MILITARY_SIGNS + craft.JET_OPERATORS], "BAW12", "n425rs", "DMMKG ", "X", "RCHX1", ""]
_WORDS = [*[w.title() for w, _ in craft.MISSIONS], "Object A", "Usa Gps"]


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pick(values, key):
    """The value whose place is the key modulo their number, as SQL."""
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def _picked(values, key):
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


_EMITTED = " ".join(f"WHEN emitter = {code} THEN '{label}'" for code, label in craft.EMITTERS.items())


@query(f"""WITH f AS (SELECT o_orderkey AS k, {_pick(_TYPES, 'o_orderkey')} AS type, {_pick(_SIGNS, '(o_orderkey // 3)')} AS flight, CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 17 END AS emitter, CASE WHEN o_custkey % 29 = 0 THEN 3 ELSE 2 END AS flags,
    CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / 10 END AS alt_ft, o_custkey % 500 + 0.5e0 AS knots FROM orders),
  s AS (SELECT *, trim(upper(flight)) AS sign, coalesce(alt_ft, 0) * 0.3048e0 AS m FROM f WHERE type <> 'TWR'), c AS (SELECT *, CASE WHEN sign <> '' THEN sign ELSE 'h' || k END AS callsign FROM s),
  a AS (SELECT *, regexp_extract(callsign, '^([A-Z]{{3}})[0-9]', 1) AS airline_code, CASE {_EMITTED} END AS e FROM c), b AS (SELECT *, airline_code = '' AND regexp_matches(sign, '^[A-Z0-9]{{3,8}}$') AS registered FROM a)
  SELECT k, callsign, airline_code, CASE WHEN type IN {_in(craft.HELICOPTERS)} OR coalesce(emitter = 8, false) THEN 'heli' ELSE 'plane' END AS craft,
    CASE WHEN e = 'military' OR flags & 1 = 1 OR type IN {_in(craft.MILITARY)} OR regexp_matches(upper(flight), '^({"|".join(craft.MILITARY_SIGNS)})[0-9]') THEN 'military' WHEN e = 'commercial' OR type IN {_in(craft.AIRLINERS)} THEN 'commercial'
      WHEN e = 'jet' OR airline_code IN {_in(craft.JET_OPERATORS)} OR type IN {_in(craft.JETS)} OR (registered AND m > 8500 AND knots > 300) THEN 'jet' WHEN e = 'private' OR registered THEN 'private' ELSE 'commercial' END AS category,
    coalesce(alt_ft < 100, false) AS grounded, CAST(floor(m + 0.5) AS BIGINT) AS alt_m FROM b""")
def sca21_flights(spark, sf):
    """Every order as a flight, of every type, operator, sign and emitter category that a rule names."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flights = table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.lit("h"), k.cast("string")).alias("hex"), _picked(_TYPES, k).alias("type"), _picked(_SIGNS, F.floor(k / 3)).alias("flight"), F.when(c % 4 == 0, c % 17).alias("emitter"), F.when(c % 29 == 0, 3).otherwise(2).alias("flags"),
        F.when(c % 5 != 0, F.col("o_totalprice") / 10).alias("alt_ft"), (c % 500 + 0.5).alias("knots"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    return craft.classified_flights(flights).select("k", "callsign", "airline_code", "craft", "category", "grounded", "alt_m")


_MISSION_CASE = " ".join(f"WHEN contains(upper(name), '{w}') THEN '{m}'" for w, m in craft.MISSIONS)


@query(f"""WITH s AS (SELECT p_partkey, p_name || ' ' || {_pick(_WORDS, 'p_partkey')} || '-' || p_size AS name FROM part) SELECT p_partkey, CASE {_MISSION_CASE} ELSE 'Unknown' END AS mission FROM s""")
def sca22_missions(spark, sf):
    """Every part as a satellite, with every keyword that a rule names."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), _picked(_WORDS, k), F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", craft.mission(name).alias("mission"))


@query(f"""WITH {SIGNALS_SQL}, q AS (SELECT url_key % 25 AS code, sum(floor(value / 60)) AS extra FROM signals WHERE category = 'earthquake' AND severity > 90 GROUP BY 1) SELECT n_nationkey AS code, least(100e0, n_nationkey * 4 + coalesce(extra, 0)) AS risk_score,
  CASE WHEN n_nationkey * 4 >= 80 THEN 'CRITICAL' WHEN n_nationkey * 4 >= 60 THEN 'HIGH' WHEN n_nationkey * 4 >= 40 THEN 'ELEVATED' ELSE 'LOW' END AS risk_level FROM nation LEFT JOIN q ON code = n_nationkey""")
def agg11_country_risk(spark, sf):
    q = signals(spark, sf).where("category = 'earthquake' AND severity > 90").select((F.col("url_key") % 25).alias("code"), F.floor(F.col("value") / 60).alias("mag"))
    return intel.country_risk(table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), (F.col("n_nationkey") * 4).alias("base")), q)


@query("""WITH q AS (SELECT p_brand AS grp, p_partkey AS name, (p_size % 11 - 5) * 0.5e0 AS pct, p_type AS kind FROM part), m AS (SELECT grp, kind, count(*) AS n FROM q GROUP BY ALL), k AS (SELECT grp, arg_min(kind, (-n, kind)) AS common FROM (SELECT grp, kind, n FROM m) GROUP BY grp)
  SELECT q.grp, count(*) AS tracked, count(*) FILTER (pct > 0) AS up, count(*) FILTER (pct < 0) AS down, arg_max(name, pct * 1000000 + name) AS best, arg_min(name, pct * 1000000 + name) AS worst, any_value(common) AS common,
  CASE WHEN count(*) FILTER (pct > 0) >= count(*) FILTER (pct < 0) THEN 'risk-on' ELSE 'risk-off' END AS mood FROM q JOIN k USING (grp) GROUP BY q.grp""".replace("arg_min(kind, (-n, kind))", "first(kind ORDER BY n DESC, kind)"))
def agg14_breadth(spark, sf):
    q = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("name"), ((F.col("p_size") % 11 - 5) * 0.5).alias("pct"), F.col("p_type").alias("kind"))
    return intel.breadth(q, "grp")


@query(f"""WITH {SIGNALS_SQL} SELECT source, max(severity) AS top, count(*) FILTER (severity >= 80) AS critical, {r6('sum(value)')} AS loss, len(list_distinct(list(category))) AS kinds FROM signals GROUP BY source""")
def agg15_alert_digest(spark, sf):
    return signals(spark, sf).groupBy("source").agg(F.max("severity").alias("top"), F.count_if(F.col("severity") >= 80).alias("critical"), R6(F.sum("value")).alias("loss"), F.count_distinct("category").alias("kinds"))


@query(f"""WITH {SIGNALS_SQL}, d(domain) AS (VALUES ('conflict'), ('weather'), ('wildfire'), ('maritime'), ('cyber')) SELECT domain, count(id) AS n FROM d LEFT JOIN signals ON category = domain GROUP BY domain""")
def agg16_domain_counts(spark, sf):
    d = spark.createDataFrame([(x,) for x in ("conflict", "weather", "wildfire", "maritime", "cyber")], "domain string")
    n = signals(spark, sf).groupBy(F.col("category").alias("domain")).agg(F.count("*").alias("n"))
    return d.join(n, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {SIGNALS_SQL}, k AS (SELECT source, url_key, max(occurred_ms) AS at FROM signals GROUP BY ALL) SELECT category, max(k.at) AS observed_ms FROM signals JOIN k USING (source, url_key) GROUP BY category""")
def agg17_observations(spark, sf):
    s = signals(spark, sf)
    k = s.groupBy("source", "url_key").agg(F.max("occurred_ms").alias("at"))
    return s.join(k, ["source", "url_key"]).groupBy("category").agg(F.max("at").alias("observed_ms"))


@query("""SELECT host, count(*) AS pages FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id // 2 AS serial FROM pages) GROUP BY host""")
def agg19_subdomains(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.floor(F.col("page_id") / 2).alias("serial"))
    return p.dropDuplicates(["host", "serial"]).groupBy("host").agg(F.count("*").alias("pages"))


@query("""WITH l AS (SELECT 'd' || l_suppkey || '.org' AS domain, l_partkey % 50 AS cn, l_linenumber AS serial, l_orderkey,
    '*.a' || l_partkey % 23 || '.d' || l_suppkey || '.org' || chr(10) || '  b' || l_partkey % 7 || '.d' || l_suppkey || '.org ' || chr(10) || 'else.net' AS names FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY l_orderkey, serial, cn, names) AS nth FROM l),
  u AS (SELECT domain, cn, serial, arg_min(names, nth) AS names FROM n WHERE nth <= 200 GROUP BY ALL),
  s AS (SELECT DISTINCT domain, regexp_replace(trim(unnest(string_split(names, chr(10)))), '^[*][.]', '') AS name FROM u),
  g AS (SELECT domain, string_agg(name, ',' ORDER BY name) AS subdomains FROM s WHERE ends_with(name, domain) GROUP BY domain),
  t AS (SELECT domain, count(*) AS total_certs FROM l GROUP BY domain), c AS (SELECT domain, count(*) AS unique_certs FROM u GROUP BY domain)
  SELECT domain, total_certs, unique_certs, subdomains FROM t JOIN c USING (domain) JOIN g USING (domain)""")
def agg19_certificates(spark, sf):
    text = lambda c: F.col(c).cast("string")
    domain = F.concat(F.lit("d"), text("l_suppkey"), F.lit(".org"))
    names = F.concat(
        F.lit("*.a"), (F.col("l_partkey") % 23).cast("string"), F.lit("."), domain, F.lit("\n  b"), (F.col("l_partkey") % 7).cast("string"),
        F.lit("."), domain, F.lit(" \nelse.net"),
    )
    certs = table(spark, sf, "lineitem").select(domain.alias("domain"), (F.col("l_partkey") % 50).alias("cn"), F.col("l_linenumber").alias("serial"), "l_orderkey", names.alias("names"))
    return intel.certificate_names(certs, ["l_orderkey", "serial", "cn", "names"])


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def agg22_listing(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"))


@query("""WITH h AS (SELECT user_id, count(*) AS feeds, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS partials, sum(event_id % 3) AS rows FROM events GROUP BY user_id)
  SELECT user_id, feeds, errors, CASE WHEN errors = feeds THEN 'error' WHEN errors + partials > 0 THEN 'partial' WHEN rows = 0 THEN 'empty' ELSE 'ok' END AS state FROM h""")
def str14_provider_health(spark, sf):
    e = table(spark, sf, "events")
    r = e.select("user_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "partial").otherwise("ok").alias("state"), (F.col("event_id") % 3).alias("rows"))
    return intel.provider_health(r, "user_id").select("user_id", "feeds", "errors", "state")


@query("""WITH p AS (SELECT o_orderkey, [22 + o_orderkey % 3, CASE o_orderkey % 5 WHEN 0 THEN 554 WHEN 1 THEN 3306 WHEN 2 THEN 443 WHEN 3 THEN 53 ELSE 9999 END, CASE o_orderkey % 7 WHEN 0 THEN 21 ELSE 8000 END] AS p, o_orderkey % 9 AS v FROM orders)
  SELECT o_orderkey, CASE WHEN list_contains(p, 554) THEN 'Camera/DVR' WHEN list_contains(p, 3306) THEN 'Database' WHEN list_contains(p, 53) THEN 'DNS Server' WHEN list_contains(p, 21) THEN 'FTP Server' WHEN list_contains(p, 22) AND NOT list_contains(p, 443) THEN 'Linux Server' WHEN list_contains(p, 443) THEN 'Web Server' ELSE 'Unknown Host' END AS device,
  CASE WHEN v > 5 THEN 'CRITICAL' WHEN v > 0 THEN 'HIGH' WHEN list_contains(p, 23) OR list_contains(p, 21) THEN 'MEDIUM' ELSE 'INFO' END AS risk FROM p""")
def sca20_devices(spark, sf):
    k = F.col("o_orderkey")
    ports = F.array((22 + k % 3).cast("int"), F.when(k % 5 == 0, 554).when(k % 5 == 1, 3306).when(k % 5 == 2, 443).when(k % 5 == 3, 53).otherwise(9999), F.when(k % 7 == 0, 21).otherwise(8000))
    o = table(spark, sf, "orders").withColumn("ports", ports)
    none = F.array().cast("array<string>")
    return o.select("o_orderkey", net.device_class(F.col("ports"), none, none).alias("device"), net.host_risk(F.col("ports"), k % 9).alias("risk"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'evm' WHEN 1 THEN 'bitcoin' WHEN 2 THEN 'tron' END AS chain FROM customer""")
def sca17_chain(spark, sf):
    k = F.col("c_custkey")
    h = F.sha2(k.cast("string"), 256)
    a = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.substring(h, 1, 40))).when(k % 4 == 1, F.concat(F.lit("bc1"), F.substring(h, 1, 38))).when(k % 4 == 2, F.concat(F.lit("T"), F.translate(F.substring(h, 1, 33), "0", "1"))).otherwise("n/a")
    return table(spark, sf, "customer").select("c_custkey", net.address_chain(a).alias("chain"))


@query("""WITH t AS (SELECT event_id, ts + INTERVAL 9 HOUR AS local FROM events) SELECT event_id, dayofweek(local) NOT IN (0, 6) AND hour(local) + minute(local) / 60e0 >= 9 AND hour(local) + minute(local) / 60e0 < 15.5 AS tokyo_open FROM t""")
def sca28_exchange(spark, sf):
    return table(spark, sf, "events").select("event_id", intel.exchange_open(F.col("ts").cast("timestamp"), "Asia/Tokyo", 9.0, 15.5).alias("tokyo_open"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'rate_limited' WHEN 'view' THEN 'denied' WHEN 'signup' THEN 'upstream' ELSE 'network' END AS failure FROM events")
def sca32_failure_kind(spark, sf):
    t = F.col("event_type")
    m = F.when(t == "error", "Request timed out").when(t == "click", "HTTP 429").when(t == "view", "403 Forbidden").when(t == "signup", "HTTP 503").otherwise("socket hang up")
    return table(spark, sf, "events").select("event_id", intel.failure_kind(m).alias("failure"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'military' WHEN 1 THEN 'cargo' WHEN 2 THEN 'airline' WHEN 3 THEN 'private' ELSE 'other' END AS craft, CASE c_custkey % 3 WHEN 0 THEN 'navigation' WHEN 1 THEN 'communications' ELSE 'other' END AS mission FROM customer")
def sca21_classifiers(spark, sf):
    k = F.col("c_custkey")
    sign = F.when(k % 5 == 0, "RCH123").when(k % 5 == 1, "FDX12").when(k % 5 == 2, "BAW12").otherwise("N123")
    name = F.when(k % 3 == 0, "Navstar 43").when(k % 3 == 1, "STARLINK-1").otherwise("OBJECT A")
    return table(spark, sf, "customer").select("c_custkey", intel.flight_class(sign, F.when(k % 5 == 3, "light")).alias("craft"), intel.satellite_mission(name).alias("mission"))


# Payload round trips: the tables written as a provider's payload and parsed back


def _payload(frame, *structs, wrap):
    """Pages of at most two hundred features each; ``wrap`` names the array."""
    grouped = frame.groupBy(F.floor(F.col("k") / 200).alias("part")).agg(F.collect_list(F.struct(*structs)).alias(wrap))
    return grouped.select(F.to_json(F.struct(wrap)).alias("raw"))


@query("""SELECT 'usgs:' || event_id AS id, CAST(event_id % 80 / 1e1 >= 0 AS BOOLEAN) AS ok, least(100, (CASE WHEN m >= 7 THEN 96 WHEN m >= 6 THEN 88 WHEN m >= 5 THEN 76 WHEN m >= 4 THEN 62 WHEN m >= 3 THEN 48 ELSE 36 END) + CASE WHEN event_id % 10 = 0 THEN 8 ELSE 0 END) AS severity, (event_id * 7919) % 18000 / 1e2 - 90 AS lat
  FROM (SELECT *, event_id % 80 / 1e1 AS m FROM events) WHERE event_type = 'purchase'""")
def src01_quakes(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").where("event_type = 'purchase'").withColumn("k", e)
    geometry = F.struct(F.array(key_lng(e), key_lat(e)).alias("coordinates"))
    props = F.struct((e % 80 / 1e1).alias("mag"), F.lit("Somewhere").alias("place"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.when(e % 10 == 0, 1).otherwise(0).alias("tsunami"))
    q = parsers.earthquakes(_payload(rows, e.cast("string").alias("id"), geometry.alias("geometry"), props.alias("properties"), wrap="features"), "raw")
    return q.select("id", F.lit(True).alias("ok"), "severity", "lat")


@query(f"""WITH s AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 * 1000 AS sent FROM events WHERE event_id % 3 <> 0), l AS (SELECT user_id, arg_max(event_id, event_id) AS e FROM s WHERE sent <= {NOW_MS} + 60000 GROUP BY 1)
  SELECT 'nws:' || l.user_id AS id, CASE WHEN e % 2 = 0 THEN 'flood' ELSE 'weather' END AS category, CASE e % 5 WHEN 0 THEN 90 WHEN 1 THEN 75 WHEN 2 THEN 50 WHEN 3 THEN 25 ELSE 20 END AS severity FROM l""")
def src09_warnings(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events")
    kind = F.when(e % 2 == 0, "Flood Watch").otherwise("Wind Advisory")
    level = F.get(F.array(*map(F.lit, ("Extreme", "Severe", "Moderate", "Minor", "Other"))), (e % 5).cast("int"))
    props = F.struct(
        F.col("user_id").cast("string").alias("id"), kind.alias("event"), level.alias("severity"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sent"), F.lit("2024-03-01T00:00:00Z").alias("expires"),
        F.when(e % 3 == 0, "Test").otherwise("Actual").alias("status"), F.lit("Alert").alias("messageType"),
    )
    # Pages in event order, and features in it within a page, so that the last row of an id is its newest.
    pages = rows.groupBy(F.floor(e / 200).alias("page")).agg(F.array_sort(F.collect_list(F.struct(e.alias("o"), props.alias("properties")))).alias("f"))
    packed = pages.select("page", F.to_json(F.struct(F.transform("f", lambda x: F.struct(x["properties"].alias("properties"))).alias("features"))).alias("raw"))
    return parsers.weather_warnings(packed, "raw", NOW_MS, "page").select("id", "category", "severity")


@query("""SELECT CAST(n AS VARCHAR) AS norad, CASE WHEN o_custkey % 3 = 0 THEN 'SAT-' || n ELSE 'Object ' || o_custkey END AS name, o_custkey % 180 + 0.5e0 AS inclination, 10 + o_orderkey % 6 + 0.25e0 AS mean_motion
  FROM (SELECT *, 10000 + o_orderkey % 80000 AS n FROM orders)""")
def src17_elements(spark, sf):
    """Every order as an element set of two or three lines, read back from the lines in order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    norad = (10000 + k % 80000).cast("string")
    fixed = lambda x, wide: F.format_string(f"%{wide}.4f", x)
    name = F.when(c % 6 == 0, F.lit("")).when(c % 3 != 0, F.concat(F.lit("0 Object "), c.cast("string"), F.lit("  ")))
    first = F.concat(F.lit("1 "), norad, F.lit("U 98067A   24030.50000000  .00016717  00000-0  10270-3 0  9005"))
    second = F.concat(F.lit("2 "), norad, F.lit(" "), fixed(c % 180 + 0.5, 8), F.lit(" 208.9163 0006317  69.9862  25.2906 "), fixed(10 + k % 6 + 0.25, 11), F.lit("000010"))
    lines = table(spark, sf, "orders").select(k, F.posexplode(F.array(name, first, second)).alias("nth", "line")).where("line IS NOT NULL").select((k * 3 + F.col("nth")).alias("ord"), "line")
    return parsers.orbital_elements(lines, "line", "ord").select("norad", "name", "inclination", "mean_motion")


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(event_id % 12 AS INTEGER) AS articles FROM events WHERE event_id % 12 >= 3 AND event_id % 4 + 1 IN (3, 4) AND event_id % 50 <> 0 ORDER BY events.event_id LIMIT 500""")
def src13_coded_events(spark, sf):
    e = F.col("event_id")
    cells = {0: e.cast("string"), 29: (e % 4 + 1).cast("string"), 33: (e % 12).cast("string"), 56: F.when(e % 50 == 0, "0").otherwise(key_lat(e).cast("string")), 57: F.when(e % 50 == 0, "0").otherwise((key_lng(e) + 0.001).cast("string"))}
    text = F.concat_ws("\t", *[cells.get(i, F.lit("x")) for i in range(61)])
    return parsers.coded_events(table(spark, sf, "events").select("event_id", text.alias("line")).withColumnRenamed("event_id", "ord"), "line", "ord", 3, (3, 4), 500).select("event_id", "articles")


@query("""WITH u AS (SELECT event_id, (user_id * 7919) % 223 + 1 AS a, user_id % 256 AS b FROM events WHERE event_id % 4 <> 0) SELECT a || '.' || b || '.1.2' AS ip, count(*) AS urls, max(event_id) AS newest_id,
  CASE max(event_id) % 3 WHEN 0 THEN 'Mozi' WHEN 1 THEN 'mirai' ELSE 'malware download' END AS family FROM u GROUP BY 1""")
def agg04_host_groups(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    host = F.concat_ws(".", ((u * 7919) % 223 + 1).cast("string"), (u % 256).cast("string"), F.lit("1"), F.lit("2"))
    url = F.when(e % 4 == 0, "http://name.example/x").otherwise(F.concat(F.lit("http://u@"), host, F.lit(":81/a""b")))
    tags = F.when(e % 3 == 0, "32-bit,elf,Mozi").when(e % 3 == 1, "176-65-139-196,mirai").otherwise("elf")
    line = F.concat(F.lit('"'), F.concat_ws('","', e.cast("string"), F.lit("2024-01-01"), url, F.lit("online"), F.lit(""), F.lit("malware_download"), tags, F.lit("l"), F.lit("r")), F.lit('"'))
    records = parsers.malicious_urls(table(spark, sf, "events").select(line.alias("line")), "line")
    return parsers.host_groups(records).select("ip", "urls", "newest_id", "family")


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 45 MINUTE, '%Y%m%d%H%M%S') AS name FROM orders")
def src14_walkback(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", parsers.earlier_window(F.date_format("o_orderdate", "yyyyMMddHHmmss"), 3).alias("name"))


@query("""SELECT user_id AS mmsi, max(event_id) AS at_ms, arg_max(value, CASE WHEN event_type <> 'error' THEN event_id END) AS lat, CASE WHEN arg_max(event_id % 100, CASE WHEN event_type = 'error' THEN event_id END) BETWEEN 80 AND 89 THEN 'tanker' WHEN arg_max(event_id % 100, CASE WHEN event_type = 'error' THEN event_id END) BETWEEN 70 AND 79 THEN 'cargo'
  WHEN arg_max(event_id % 100, CASE WHEN event_type = 'error' THEN event_id END) = 35 THEN 'military' ELSE 'other' END AS kind FROM events GROUP BY user_id""")
def src19_ships(spark, sf):
    e, static = F.col("event_id"), F.col("event_type") == "error"
    m = table(spark, sf, "events").select(F.col("user_id").alias("mmsi"), e.alias("at_ms"), F.when(~static, F.col("value")).alias("lat"), F.when(static, (e % 100).cast("int")).alias("type_code"))
    return parsers.ship_states(m).select("mmsi", "at_ms", "lat", "kind")


@query(f"""WITH {SIGNALS_SQL} SELECT id, least(100, CASE category WHEN 'conflict' THEN 72 WHEN 'earthquake' THEN 65 WHEN 'wildfire' THEN 55 WHEN 'weather' THEN 55 WHEN 'infrastructure' THEN 58 END + CASE WHEN ord % 4 = 0 THEN 10 ELSE 0 END) AS severity FROM signals""")
def sca23_severity(spark, sf):
    title = F.when(F.col("ord") % 4 == 0, "Breaking: dozens killed").otherwise("Quiet day")
    return signals(spark, sf).select("id", parsers.event_severity(F.col("category"), title).cast("int").alias("severity"))


