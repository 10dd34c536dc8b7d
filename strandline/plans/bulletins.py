"""News pages and signals, dated lists, digests, past reviews, driving instructions and origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandline.functions import geo, lookups, text
from strandline.operators import bulletins as ops
from strandline.operators import fusion
from strandline.plans.feed import R6, r6
from strandline.plans.fusion import _CASES, _HITS
from strandline.plans.lookups import _WHERE
from strandline.sources.adapters import ARTICLES_SQL, NOW_MS, SIGNALS_SQL, articles, key_lat, key_lng, signals, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STEPS = (
    (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li)>", "\n"), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'),
    ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), (r"[^\S\n]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"),
)
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_plain = lambda sql: "trim(" + reduce(lambda s, step: f"regexp_replace({s}, {_quoted(step[0])}, {_quoted(step[1])}, 'g')", _STEPS, sql) + ", ' ')"
_BLOCKS = rf"""cut AS (SELECT page_id, lower(split_part(url, '/', 3)) AS host, unnest(string_split(html, '<p>')[2:]) AS block, generate_subscripts(string_split(html, '<p>')[2:], 1) AS place FROM pages),
  said AS (SELECT page_id, host, place, {_plain("string_split(block, '</p>')[1]")} AS description FROM cut WHERE contains(block, '</p>')),
  head AS (SELECT *, coalesce(nullif(regexp_extract(description, '^([^\n]*?[.!?])\s', 1), ''), nullif(regexp_extract(description, '^[^\n]*'), ''), description) AS f FROM said WHERE len(description) >= 20),
  items AS (SELECT page_id, host, place, description, CASE WHEN len(f) > 160 THEN substr(f, 1, 157) || '...' ELSE f END AS title FROM head)"""


def _paragraphs(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), "html")
    return ops.page_blocks(pages, "html", "<p>", "</p>")


@query(f"""WITH {_BLOCKS} SELECT page_id, host, place, title, sha256(description) AS description FROM items QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id DESC, place DESC) <= 8""")
def src04_channel_blocks(spark, sf):
    """The last eight paragraphs of every host's pages, as a channel page has its newest messages at the end."""
    kept = ops.per_source(_paragraphs(spark, sf), "host", ["page_id", "place"], 8, last=True)
    return kept.select("page_id", "host", F.col("place").cast("long").alias("place"), "title", F.sha2("description", 256).alias("description"))


@query(f"""WITH {_BLOCKS} SELECT page_id, host, place, title FROM items WHERE len(title) >= 8 QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id, place) <= 12""")
def src04_feed_items(spark, sf):
    """The first twelve items of every host's pages, as a feed has its newest items first; titles of eight characters or more."""
    kept = ops.per_source(_paragraphs(spark, sf).where(F.length("title") >= 8), "host", ["page_id", "place"], 12)
    return kept.select("page_id", "host", F.col("place").cast("long").alias("place"), "title")


_LEADS = (
    "Earthquake shakes Tehran. ", "Riot and storm in Paris. ", "Missile attack explosion in Kyiv. ", "Daily briefing\n- London\n- Moscow. ", "Ransomware in Berlin. ", "", "Nothing new. ",
)
_OSINT, _BROADCAST, _DEPENDENT = ("src3", "src7"), ("src1", "src11"), ("src1", "src7", "src11")
_list = lambda names: "[" + ", ".join(map(_quoted, names)) + "]"
_in = lambda names: "(" + ", ".join(map(_quoted, names)) + ")"
_DIGEST = "(regexp_matches(title || chr(10) || description, " + _quoted(text.DIGEST_LABEL.replace("(?iu)", "(?i)")) + ") AND len(regexp_extract_all(title || chr(10) || description, " + _quoted(text.DIGEST_ITEM) + ")) >= 2)"
_ITEMS = rf"""{ARTICLES_SQL}, a AS (SELECT doc_id, title, {_list(_LEADS)}[doc_id % {len(_LEADS)} + 1] || description AS description, source, published_ms, CAST(regexp_extract(source, '\d+') AS INTEGER) AS n FROM articles WHERE title IS NOT NULL),
  w AS (SELECT *, (n * 7 % 10) / 1e1 + 0.037e0 AS weight FROM a), b AS (SELECT DISTINCT title, source, n, weight FROM w),
  c AS (SELECT title, count(*) AS sources, sum(weight) AS ew, count(*) FILTER (n % 2 = 0) AS ind, count(*) FILTER (n % 3 = 0) AS ed FROM b GROUP BY title),
  s AS (SELECT *, least(1e0, 0.26e0 + least(0.34e0, ew * 0.15e0) + least(0.12e0, ind * 0.05e0) + least(0.12e0, ed * 0.04e0) + least(0.08e0, (sources - 1) * 0.04e0)) AS score FROM c),
  p AS (SELECT title, first(doc_id ORDER BY weight DESC, published_ms DESC, doc_id) AS doc_id FROM w GROUP BY title),
  items AS (SELECT substr(sha256(title), 1, 16) AS item, title, description, source AS primary_source, published_ms, sources, ew, lower(title || ' ' || description) AS low,
    CASE WHEN score >= 0.78 THEN 'high' WHEN score >= 0.56 THEN 'medium' ELSE 'low' END AS confidence FROM s JOIN p USING (title) JOIN (SELECT doc_id, description, source, published_ms FROM a) USING (doc_id))"""


def _news(spark, sf):
    """News items of equal first lines, and the sources that have each: ``(items, members)``."""
    a = articles(spark, sf).where("title IS NOT NULL").withColumn("n", F.regexp_extract("source", r"\d+", 0).cast("int"))
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("doc_id") % len(_LEADS) + 1).cast("int"))
    a = a.withColumn("description", F.concat(lead, "description"))
    w = a.select("doc_id", "title", "source", "published_ms", ((F.col("n") * 7 % 10) / 1e1 + 0.037).alias("weight"), (F.col("n") % 2 == 0).alias("independent"), (F.col("n") % 3 == 0).alias("editorial"))
    sums = fusion.news_confidence(w, "title").select("title", F.col("sources").alias("source_count"), F.col("weight").alias("evidence_weight"), "confidence")
    first = w.groupBy("title").agg((-F.max(F.struct("weight", "published_ms", (-F.col("doc_id")).alias("nd")))["nd"]).alias("doc_id"))
    texts = a.select("doc_id", "description", F.col("source").alias("primary_source"), "published_ms")
    item = F.substring(F.sha2("title", 256), 1, 16)
    items = sums.join(first, "title").join(texts, "doc_id").withColumns({"item": item, "risk": text.risk_score(F.concat_ws(" ", "title", "description")), "link": F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string"))})
    return items, w.select(item.alias("item"), "source").distinct()


@query(f"""WITH {_ITEMS}, r AS (SELECT *, {_DIGEST} AS digest, CAST(least(10, greatest(1, floor(1 + ({_HITS}) * 1.15e0 + regexp_matches(low, '{text.URGENT}')::INTEGER + 0.5))) AS INTEGER) AS risk, CASE {_WHERE} END AS place, CASE {_CASES} ELSE 'other' END AS category FROM items)
  SELECT 'news:' || item AS id, category, published_ms AS occurred_ms, CAST(least(100, greatest(10, risk * 9 + CASE confidence WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 0 END)) AS INTEGER) AS severity,
    CASE WHEN NOT digest THEN place END AS location, digest, sources AS source_count_hint, {r6('ew')} AS evidence_weight_hint FROM r""")
def src05_news_signals(spark, sf):
    s = ops.news_signals(_news(spark, sf)[0])
    return s.select("id", "category", "occurred_ms", "severity", "location", "digest", "source_count_hint", R6(F.col("evidence_weight_hint")).alias("evidence_weight_hint"))


@query(f"""WITH {_ITEMS} SELECT 'news:' || item AS id, 'news:' || b.source AS source_id, CASE WHEN b.source IN {_in(_OSINT)} THEN 'osint' WHEN b.source IN {_in(_BROADCAST)} THEN 'broadcaster' ELSE 'editorial' END AS kind,
    b.source NOT IN {_in(_DEPENDENT)} AS independent, {r6('greatest(0.4e0, ew / sources)')} AS weight, CASE WHEN b.source = primary_source THEN 'https://news.example/' || doc_id END AS url, published_ms
  FROM (SELECT items.*, p.doc_id FROM items JOIN p USING (title)) i JOIN b USING (title)""")
def src05_news_evidence(spark, sf):
    items, members = _news(spark, sf)
    e = ops.news_evidence(items, members, _OSINT, _BROADCAST, _DEPENDENT)
    return e.select("id", "source_id", "kind", "independent", R6(F.col("weight")).alias("weight"), "url", "published_ms")


_VULN_NOW = 883612800000


@query(f"""WITH v AS (SELECT 'CVE-' || o_custkey AS cve, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, o_orderkey AS place, o_orderpriority AS term, epoch_ms(o_orderdate) AS published_ms,
    CASE WHEN o_orderkey % 3 = 0 THEN 9.8e0 END AS v31, CASE WHEN o_orderkey % 2 = 0 THEN 7.5e0 END AS v30, CASE WHEN o_orderkey % 5 > 0 THEN 5e0 END AS v2 FROM orders)
  SELECT cve, term, published_ms, coalesce(v31, v30, v2) AS score FROM v WHERE published_ms BETWEEN {_VULN_NOW - 119 * 86400000} AND {_VULN_NOW} QUALIFY row_number() OVER (PARTITION BY cve ORDER BY rank, place) = 1""")
def src18_dated_list(spark, sf):
    """Vulnerabilities of the last 119 days (200 are asked for), once an id, as the first term found them."""
    k = F.col("o_orderkey")
    found = table(spark, sf, "orders").select(
        F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string")).alias("cve"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), k.alias("place"), F.col("o_orderpriority").alias("term"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("published_ms"), F.when(k % 3 == 0, 9.8).alias("v31"), F.when(k % 2 == 0, 7.5).alias("v30"), F.when(k % 5 > 0, 5.0).alias("v2"),
    )
    return ops.dated_vulnerabilities(found, _VULN_NOW, 200)


_ASSETS = " ".join(f"WHEN regexp_matches(address, '{shape}') THEN '{asset}'" for asset, shape in lookups.ASSET_SHAPES)
_WALLETS = f"""h AS (SELECT c_custkey AS k, c_nationkey, c_name, replace(sha256(c_name), '0', 'x') AS b, sha256(c_name) AS h FROM customer),
  n AS (SELECT k, c_nationkey, CASE k % 5 WHEN 0 THEN '0x' || substr(h, 1, 40) WHEN 1 THEN '1' || substr(b, 1, 30) WHEN 2 THEN 'T' || substr(b, 1, 33) WHEN 3 THEN '4A' || substr(b || b, 1, 93) ELSE c_name END AS address,
    CASE WHEN k % 11 > 0 THEN {NOW_MS} - k % 900 * 86400000::BIGINT END AS seen FROM h),
  wallets AS (SELECT *, CASE {_ASSETS} END AS asset FROM n WHERE asset IS NOT NULL AND (seen IS NULL OR seen >= {NOW_MS} - 365 * 86400000::BIGINT))"""


def _wallets(spark, sf):
    k, plain = F.col("c_custkey"), F.sha2("c_name", 256)
    coded = F.replace(plain, F.lit("0"), F.lit("x"))
    address = (
        F.when(k % 5 == 0, F.concat(F.lit("0x"), F.substring(plain, 1, 40))).when(k % 5 == 1, F.concat(F.lit("1"), F.substring(coded, 1, 30)))
        .when(k % 5 == 2, F.concat(F.lit("T"), F.substring(coded, 1, 33))).when(k % 5 == 3, F.concat(F.lit("4A"), F.substring(F.concat(coded, coded), 1, 93))).otherwise(F.col("c_name"))
    )
    seen = F.when(k % 11 > 0, F.lit(NOW_MS) - k % 900 * ops.DAY_MS)
    entries = table(spark, sf, "customer").select(k.alias("k"), "c_nationkey", address.alias("address"), seen.alias("first_seen_ms"))
    return ops.designated_wallets(entries, lookups.address_asset(F.col("address")), NOW_MS, 365)


@query(f"WITH {_WALLETS} SELECT k, address, asset, seen AS first_seen_ms FROM wallets")
def src18_wallets(spark, sf):
    return _wallets(spark, sf).select("k", "address", "asset", "first_seen_ms")


@query(f"""WITH {_WALLETS}, c AS (SELECT c_nationkey, asset, count(*) AS n, first({{'s': -coalesce(seen, 0), 'a': address}} ORDER BY -coalesce(seen, 0), address) AS f FROM wallets GROUP BY ALL)
  SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS total, string_agg(n || ' ' || asset, ', ' ORDER BY f.s, f.a) AS kinds FROM c GROUP BY 1""")
def agg14_asset_spread(spark, sf):
    """Designated wallets of each nation by asset, in the order in which the list, newest first, has them."""
    return ops.spread(_wallets(spark, sf), "c_nationkey", "asset", [(-F.coalesce("first_seen_ms", F.lit(0))).alias("s"), F.col("address")])


@query(f"""WITH {SIGNALS_SQL}, al AS (SELECT source AS grp, CASE category WHEN 'earthquake' THEN 'quake' WHEN 'conflict' THEN 'conflict' WHEN 'infrastructure' THEN NULL ELSE 'weather' END AS kind, ord, severity / 1e1 AS magnitude, NULL AS risk, NULL AS title,
      CASE WHEN url_key % 7 > 0 THEN category || '-' || (url_key % 7) END AS type, severity > 90 AS high FROM signals
    UNION ALL SELECT source, 'news', doc_id, NULL, CASE WHEN doc_id % 13 > 0 THEN doc_id % 12 END, split_part(text, chr(10), 1), NULL, NULL FROM documents),
  g AS (SELECT grp, count(*) FILTER (kind = 'quake') AS quakes, max(magnitude) FILTER (kind = 'quake') AS strongest, count(*) FILTER (kind = 'quake' AND magnitude >= 5) AS strong, count(*) FILTER (kind = 'news') AS news, count(*) FILTER (kind = 'news' AND risk >= 8) AS hot,
      substr(first(title ORDER BY coalesce(risk, 0) DESC, ord) FILTER (kind = 'news'), 1, 48) AS top, count(*) FILTER (kind = 'weather') AS weather, count(*) FILTER (kind = 'weather' AND high) AS high, count(*) FILTER (kind = 'conflict') AS conflicts FROM al GROUP BY grp),
  u AS (SELECT grp, type, min(ord) AS f FROM al WHERE kind = 'weather' AND type IS NOT NULL GROUP BY grp, type), t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY grp ORDER BY f) <= 3),
  j AS (SELECT grp, string_agg(type, ', ' ORDER BY f) AS types FROM t GROUP BY grp)
  SELECT g.*, coalesce(types, '') AS types, CASE WHEN hot > 0 OR high > 0 OR coalesce(strongest >= 5 AND strongest < 9.95, false) OR coalesce(regexp_matches(top, 'STORM|hot|severe|M[5-9]'), false) THEN 'ELEVATED' ELSE 'NOMINAL' END AS level FROM g LEFT JOIN j ON g.grp IS NOT DISTINCT FROM j.grp""")
def agg15_alerts(spark, sf):
    """Digest of every source's quakes, weather, conflicts and news."""
    category, none = F.col("category"), F.lit(None)
    kind = F.when(category == "earthquake", "quake").when(category == "conflict", "conflict").when(category != "infrastructure", "weather")
    seen = signals(spark, sf).select(
        F.col("source").alias("grp"), kind.alias("kind"), "ord", (F.col("severity") / 1e1).alias("magnitude"), none.cast("long").alias("risk"), none.cast("string").alias("title"),
        F.when(F.col("url_key") % 7 > 0, F.concat_ws("-", category, (F.col("url_key") % 7).cast("string"))).alias("type"), (F.col("severity") > 90).alias("high"),
    )
    d = F.col("doc_id")
    news = table(spark, sf, "documents").select(
        F.col("source").alias("grp"), F.lit("news").alias("kind"), d.alias("ord"), none.cast("double").alias("magnitude"), F.when(d % 13 > 0, d % 12).alias("risk"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), none.cast("string").alias("type"), none.cast("boolean").alias("high"),
    )
    return ops.alert_digest(seen.unionByName(news), "grp")


_PAIRS = f"""raw AS (SELECT l_suppkey AS l, l_partkey AS r, CASE WHEN l_orderkey % 20 = 0 THEN 'old' ELSE 'now' END AS epoch, CASE WHEN l_orderkey % 21 = 0 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS sampled_at,
    CASE WHEN l_orderkey % 22 = 0 THEN '' ELSE 'a' END AS lp, CASE WHEN l_quantity <> 33 THEN 'else' ELSE '{ops.PAIR_REASONS[0]}' END AS reason, CASE WHEN l_orderkey % 24 > 0 THEN l_quantity - 2 END AS km, l_linenumber * 60e0 - 60 * (l_orderkey % 25 = 0)::INTEGER * 9 AS s FROM lineitem),
  pairs AS (SELECT DISTINCT try_cast(sampled_at AS TIMESTAMP) AS sampled, l, r, lp, reason, km, s, CASE WHEN epoch <> 'now' THEN 'epoch' WHEN sampled_at = 'soon' THEN 'time' WHEN lp = '' THEN 'field' WHEN reason = 'else' THEN 'reason' WHEN km IS NULL OR km < 0 THEN 'distance' WHEN s < 0 THEN 'seconds' END AS fault FROM raw)"""


def _past_pairs(spark, sf):
    k = F.col("l_orderkey")
    reports = table(spark, sf, "lineitem").select(
        F.when(k % 20 == 0, "old").otherwise("now").alias("epoch"), F.when(k % 21 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("sampled_at"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("left_event"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("right_event"), F.when(k % 22 == 0, "").otherwise("a").alias("left_provider"),
        F.lit("b").alias("right_provider"), F.when(F.col("l_quantity") != 33, "else").otherwise(ops.PAIR_REASONS[0]).alias("reason"), F.when(k % 24 > 0, F.col("l_quantity") - 2).cast("double").alias("distance_km"),
        (F.col("l_linenumber") * 60.0 - F.when(k % 25 == 0, 540).otherwise(0)).alias("time_difference_seconds"),
    )
    return ops.historical_pairs(reports, "now")


@query(f"WITH {_PAIRS} SELECT coalesce(fault, 'none') AS fault, count(*) AS n FROM pairs GROUP BY 1")
def idr07_pair_faults(spark, sf):
    """Pairs that past reviews found, by why they can't be used."""
    return _past_pairs(spark, sf).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PAIRS}, e AS (SELECT 's' || l AS id FROM pairs WHERE fault IS NULL UNION ALL SELECT 'p' || r FROM pairs WHERE fault IS NULL), h AS (SELECT id, count(*) AS n FROM e GROUP BY 1), g AS (SELECT 'p' || p_partkey AS id, p_partkey % 3 AS m FROM part)
  SELECT id AS event_id, CASE WHEN n IS NOT NULL THEN 'manual_review' WHEN m = 0 THEN 'keep' ELSE 'propose_split_for_review' END AS action, CASE WHEN n IS NULL AND m > 0 THEN 'split' END AS proposed,
    CASE WHEN m = 1 AND n IS NULL THEN 'time_unknown' WHEN m = 1 THEN 'historical_pair_requires_review,time_unknown' WHEN n IS NULL THEN '' ELSE 'historical_pair_requires_review' END AS blockers, coalesce(n, 0) AS reviews FROM g LEFT JOIN h USING (id)""")
def idr07_held_groups(spark, sf):
    """Planned groups of parts after the pairs that past reviews found."""
    m = F.col("p_partkey") % 3
    plan = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("event_id"), F.when(m == 0, "keep").otherwise("propose_split_for_review").alias("action"), F.when(m > 0, "split").alias("proposed"),
        F.when(m == 1, F.array(F.lit("time_unknown"))).alias("blockers"),
    )
    return ops.hold_groups(plan, _past_pairs(spark, sf)).withColumn("blockers", F.array_join("blockers", ","))


_GROUP = "CASE l_partkey % 5 WHEN 0 THEN 1000000 + l_partkey WHEN 1 THEN 2000000 + l_partkey * 2 + l_suppkey % 2 WHEN 4 THEN 4000000 + l_partkey // 10 * 2 + l_suppkey % 2 ELSE 3000000 + l_partkey // 5 END"
_SEEN = f"""k AS (SELECT l_partkey AS stored, l_orderkey * 8 + l_linenumber AS identity, 1 + (l_partkey % 9 = 0 AND l_linenumber > 2)::INTEGER AS revision, l_orderkey % 997 > 0 AS news, CASE WHEN l_orderkey % 991 > 0 THEN {_GROUP} END AS current FROM lineitem)"""


@query(f"""WITH RECURSIVE {_SEEN}, i AS (SELECT stored, identity, bool_or(news) AS news, count(DISTINCT current) FILTER (news) AS groups, min(revision) FILTER (news) AS low, max(revision) FILTER (news) AS high FROM k GROUP BY 1, 2),
  s AS (SELECT stored, bool_or(NOT news OR groups <> 1) OR min(low) <> max(high) AS bad FROM i GROUP BY 1 HAVING bool_or(news)),
  l AS (SELECT DISTINCT 's:' || stored AS a, 'c:' || current AS b FROM k WHERE news AND current IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a AS n, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n), m AS (SELECT n, min(root) AS component FROM r GROUP BY n),
  w AS (SELECT coalesce(component, 's:' || stored) AS component, 1 AS st, bad FROM s LEFT JOIN m ON n = 's:' || stored UNION ALL SELECT component, 0, false FROM m WHERE n LIKE 'c:%'),
  g AS (SELECT component, count(*) FILTER (st = 1) AS stored, count(*) FILTER (st = 0) AS current, bool_or(bad) AS incomplete FROM w GROUP BY 1)
  SELECT *, CASE WHEN incomplete THEN 'review_missing_or_ambiguous_observations' WHEN stored > 1 AND current > 1 THEN 'review_overlap' WHEN stored > 1 THEN 'review_merge' WHEN current > 1 THEN 'review_split' ELSE 'review_consistent' END AS action FROM g""")
def idr04_reviews(spark, sf):
    """Components of stored events and current groups, with what to review where observations are missing."""
    k, part, odd = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey") % 2
    group = F.when(part % 5 == 0, part + 1_000_000).when(part % 5 == 1, part * 2 + 2_000_000 + odd).when(part % 5 == 4, F.floor(part / 10) * 2 + 4_000_000 + odd).otherwise(F.floor(part / 5) + 3_000_000)
    links = table(spark, sf, "lineitem").select(
        part.alias("stored"), (k * 8 + F.col("l_linenumber")).alias("identity"), F.when((part % 9 == 0) & (F.col("l_linenumber") > 2), 2).otherwise(1).alias("revision"), (k % 997 > 0).alias("news"),
        F.when(k % 991 > 0, group).alias("current"),
    )
    return ops.reviewed_components(links)


_MINUTES = "CAST(greatest(1, floor(value * 97 / 60 + 0.5)) AS BIGINT)"


@query(f"""SELECT event_id, CASE WHEN {_MINUTES} < 60 THEN {_MINUTES} || ' min' WHEN {_MINUTES} % 60 = 0 THEN {_MINUTES} // 60 || ' hr' ELSE {_MINUTES} // 60 || ' hr ' || {_MINUTES} % 60 || ' min' END AS duration,
  CASE WHEN event_type = 'error' THEN 'Ground' WHEN event_id % 9 = 0 THEN '—' ELSE format('{{:,}}', CAST(floor(value * 60 * 3.28084e0 / 25 + 0.5) AS BIGINT) * 25) || ' ft' END AS altitude FROM events""")
def sca11_duration_altitude(spark, sf):
    v, grounded = F.col("value"), F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        "event_id", geo.format_duration(v * 97).alias("duration"), geo.format_altitude(F.when(F.col("event_id") % 9 > 0, v * 60), grounded).alias("altitude")
    )


_WAYS = ("left", "right", "straight", "slight left", "")
_STEPS_NAMED = (*lookups.INSTRUCTIONS, "depart", "arrive", "roundabout", "rotary", "notification")
_KINDS = " ".join(f"WHEN number IN {tuple(n)} THEN '{kind}'" for kind, n in lookups.MANOEUVRES.items())
_TOLD = " ".join(f"WHEN kind = '{name}' THEN CASE WHEN way = '' THEN '{none}' ELSE replace('{some}', '{{}}', way) END" for name, (some, none) in lookups.INSTRUCTIONS.items())


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 32 AS number, {_list(_STEPS_NAMED)}[l_partkey % {len(_STEPS_NAMED)} + 1] AS kind, {_list(_WAYS)}[l_suppkey % {len(_WAYS)} + 1] AS said, CASE WHEN l_orderkey % 3 > 0 THEN 'Road ' || l_partkey ELSE ' ' END AS road, l_quantity % 4 AS turn FROM lineitem),
  w AS (SELECT *, CASE WHEN kind = 'continue' AND said = 'straight' THEN '' ELSE said END AS way, CASE WHEN trim(road) <> '' THEN ' onto ' || road ELSE '' END AS onto FROM s)
  SELECT l_orderkey, l_linenumber, CASE {_KINDS} ELSE 'straight' END AS icon, CASE WHEN kind = 'depart' THEN CASE WHEN onto = '' THEN 'Depart' ELSE 'Head out on ' || road END WHEN kind = 'arrive' THEN 'You have arrived at your destination'
    WHEN kind IN ('roundabout', 'rotary') THEN CASE WHEN turn > 0 THEN 'At the roundabout, take exit ' || CAST(turn AS BIGINT) ELSE 'Enter the roundabout' END || onto
    ELSE CASE {_TOLD} WHEN way = '' THEN 'Continue' ELSE 'Turn ' || way END || onto END AS told FROM w""")
def sca31_instructions(spark, sf):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    part, k = F.col("l_partkey"), F.col("l_orderkey")
    road = F.when(k % 3 > 0, F.concat(F.lit("Road "), part.cast("string"))).otherwise(" ")
    told = lookups.instruction(pick(_STEPS_NAMED, part), pick(_WAYS, F.col("l_suppkey")), road, (F.col("l_quantity") % 4).cast("long"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lookups.manoeuvre_kind(part % 32).alias("icon"), told.alias("told"))


@query("""WITH n AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS reports FROM lineitem GROUP BY 1)
  SELECT s_suppkey, coalesce(reports, 0) AS reports, CASE WHEN reports > 5 THEN 'HIGH' WHEN reports > 0 THEN 'MEDIUM' ELSE 'LOW' END AS threat FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey""")
def rsk03_threat_level(spark, sf):
    named = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("reports"))
    rows = table(spark, sf, "supplier").select("s_suppkey").join(named, "s_suppkey", "left")
    return rows.select("s_suppkey", F.coalesce("reports", F.lit(0)).alias("reports"), lookups.threat_level(F.col("reports")).alias("threat"))


_CENTROIDS = "z AS (SELECT n_nationkey, upper(substr(n_name, 1, 3)) || n_nationkey AS code, (n_nationkey * 31 * 7919) % 18000 / 1e2 - 90 AS lat, (n_nationkey * 31 * 104729) % 36000 / 1e2 - 180 AS lng FROM nation WHERE n_nationkey % 6 > 0)"


def _centroids(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 6 > 0")
    code = F.concat(F.upper(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string"))
    return n.select(code.alias("code"), key_lat(F.col("n_nationkey") * 31).alias("lat"), key_lng(F.col("n_nationkey") * 31).alias("lng"))


def _nation_codes(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.lower(F.concat(F.substring("n_name", 1, 3), F.col("n_nationkey").cast("string"))).alias("country"))
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"""WITH {_CENTROIDS} SELECT c_custkey, code, {r6('lat + ((c_custkey * 251.3e0) % 200 - 100) / 100 * 2')} AS lat, {r6('lng + ((c_custkey * 137.5e0) % 200 - 100) / 100 * 2')} AS lng FROM customer JOIN z ON c_nationkey = n_nationkey""")
def src24_outages(spark, sf):
    """Outages by country code, at the centroids of the countries that have one, moved apart by their number."""
    rows = _nation_codes(spark, sf).select("c_custkey", "country")
    return ops.at_centroids(rows, F.col("country"), _centroids(spark, sf), "c_custkey").select("c_custkey", "code", R6(F.col("lat")).alias("lat"), R6(F.col("lng")).alias("lng"))


@query(f"""WITH {_CENTROIDS}, s AS (SELECT c_nationkey, count(*) AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), t AS (SELECT c_nationkey, round(w / sum(w) OVER () * 100, 2) AS share, n_name FROM s JOIN nation ON n_nationkey = c_nationkey
    ORDER BY w DESC, lower(substr(n_name, 1, 3)) || c_nationkey LIMIT 10)
  SELECT code, lat, lng, share FROM t JOIN z ON n_nationkey = c_nationkey""")
def src24_origins(spark, sf):
    """The ten countries of the largest share of orders; those with a centroid are placed."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = _nation_codes(spark, sf).join(orders, "c_custkey").select("country", "n")
    return ops.top_origins(rows, F.col("country"), "n", _centroids(spark, sf), 10)
