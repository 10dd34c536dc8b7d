"""Ordered-scan, snapshot, ledger and identity queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions import net
from strandline.operators import commits, replay, state, tracks as ops
from strandline.plans.feed import HAV, R6, r6
from strandline.session import shared_folder
from strandline.sources.adapters import SIGNALS_SQL, TRACKS_SQL, signals, table, tracks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LEG_SQL = f"""{TRACKS_SQL}, t1 AS (SELECT *, row_number() OVER w AS nth, on_ground <> lag(on_ground) OVER w AS turn FROM tracks WINDOW w AS (PARTITION BY craft ORDER BY ord)),
  t2 AS (SELECT *, sum(CASE WHEN turn IS NULL OR turn THEN 1 ELSE 0 END) OVER (PARTITION BY craft ORDER BY ord) AS island FROM t1),
  t3 AS (SELECT *, count(*) OVER (PARTITION BY craft, island) AS run, max(CASE WHEN NOT on_ground THEN nth END) OVER (PARTITION BY craft) AS last FROM t2),
  t4 AS (SELECT *, coalesce(max(CASE WHEN on_ground AND run >= 4 AND nth < last THEN nth END) OVER (PARTITION BY craft), 0) + 1 AS start, count(*) OVER (PARTITION BY craft) AS n FROM t3),
  leg AS (SELECT * FROM t4 WHERE CASE WHEN last IS NULL THEN nth > n - 2 WHEN last - start < 1 THEN true ELSE nth BETWEEN start AND last END)"""


@query(f"WITH {LEG_SQL} SELECT craft, ord FROM leg")
def win01_current_leg(spark, sf):
    return ops.current_leg(tracks(spark, sf), "craft", "ord").select("craft", "ord")


@query(f"""WITH {LEG_SQL}, e AS (SELECT craft, arg_min(CASE WHEN alt_ft IS NULL THEN -1 ELSE alt_ft END, ord) AS a, arg_min(lat, ord) AS flat, arg_min(lng, ord) AS flng, arg_max(on_ground, ord) AS g, arg_max(lat, ord) AS tlat, arg_max(lng, ord) AS tlng, count(*) AS n FROM leg GROUP BY craft)
  SELECT craft, CASE WHEN a <= 10000 AND n >= 2 THEN flat END AS from_lat, CASE WHEN a <= 10000 AND n >= 2 THEN flng END AS from_lng, CASE WHEN g AND n >= 2 THEN tlat END AS to_lat, CASE WHEN g AND n >= 2 THEN tlng END AS to_lng FROM e""")
def win02_leg_endpoints(spark, sf):
    return ops.leg_endpoints(ops.current_leg(tracks(spark, sf), "craft", "ord"), "craft", "ord")


@query(f"""WITH {TRACKS_SQL}, t AS (SELECT craft, ord, row_number() OVER (PARTITION BY craft ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY craft) AS n FROM tracks),
  k AS (SELECT craft, n, unnest(range(20)) AS j FROM (SELECT DISTINCT craft, n FROM t WHERE n > 20))
  SELECT DISTINCT craft, ord FROM t WHERE n <= 20 OR i IN (SELECT CAST(floor(j * ((k.n - 1) / 19e0) + 0.5) AS BIGINT) FROM k WHERE k.craft = t.craft)""")
def win03_downsample(spark, sf):
    return ops.downsample(tracks(spark, sf), "craft", "ord", 20).select("craft", "ord")


STEP_SQL = f"{TRACKS_SQL}, l AS (SELECT *, lag(lat) OVER w AS alat, lag(lng) OVER w AS alng, lat AS blat, lng AS blng FROM tracks WINDOW w AS (PARTITION BY craft ORDER BY ord)), st AS (SELECT *, coalesce({HAV.format(a='a', b='b')}, 0) AS step_km FROM l)"


@query(f"WITH {STEP_SQL} SELECT craft, count(*) AS points, {r6('sum(step_km)')} AS km FROM st GROUP BY craft")
def win04_path_length(spark, sf):
    return ops.with_steps(tracks(spark, sf), "craft", "ord").groupBy("craft").agg(F.count("*").alias("points"), R6(F.sum("step_km")).alias("km"))


@query(f"WITH {STEP_SQL} SELECT craft, ord, {r6('sum(step_km) OVER (PARTITION BY craft ORDER BY ord)')} AS along_km FROM st")
def win05_cumulative(spark, sf):
    return ops.with_steps(tracks(spark, sf), "craft", "ord").select("craft", "ord", R6(F.col("along_km")).alias("along_km"))


@query(f"""WITH r AS (SELECT n_regionkey AS route_id, n_nationkey AS ord, n_nationkey * 0.01e0 AS lat, n_nationkey * 0.02e0 + n_regionkey * 0.003e0 AS lng FROM nation),
  s AS (SELECT route_id, ord AS segment, lat AS alat, lng AS alng, lead(lat) OVER w AS blat, lead(lng) OVER w AS blng FROM r WINDOW w AS (PARTITION BY route_id ORDER BY ord)),
  m AS (SELECT *, {HAV.format(a='a', b='b')} * 1000 AS leg_m FROM s WHERE blat IS NOT NULL), b AS (SELECT *, sum(leg_m) OVER (PARTITION BY route_id ORDER BY segment) - leg_m AS before_m FROM m),
  p AS (SELECT s_suppkey, s_suppkey % 5 AS route_id, (s_suppkey % 23) * 0.011e0 AS lat, (s_suppkey % 19) * 0.023e0 AS lng FROM supplier),
  j AS (SELECT s_suppkey, segment, before_m, leg_m, (alng - lng) * cos(radians(lat)) * 111320e0 AS x1, (alat - lat) * 111320e0 AS y1, (blng - lng) * cos(radians(lat)) * 111320e0 AS x2, (blat - lat) * 111320e0 AS y2 FROM p JOIN b USING (route_id)),
  k AS (SELECT *, greatest(0e0, least(1e0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / greatest(pow(x2 - x1, 2) + pow(y2 - y1, 2), 1e-9))) AS t FROM j),
  o AS (SELECT *, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS off_m, before_m + t * leg_m AS along_m FROM k)
  SELECT s_suppkey, segment, floor(off_m * 1e3 + 0.5) / 1e3 AS off_m, floor(along_m * 1e3 + 0.5) / 1e3 AS along_m FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY off_m, segment) AS n FROM o) WHERE n = 1""")
def win06_snap(spark, sf):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    route = table(spark, sf, "nation").select(r.alias("route_id"), n.alias("ord"), (n * 0.01).alias("lat"), (n * 0.02 + r * 0.003).alias("lng"))
    k = F.col("s_suppkey")
    points = table(spark, sf, "supplier").select("s_suppkey", (k % 5).cast("int").alias("route_id"), ((k % 23) * 0.011).alias("lat"), ((k % 19) * 0.023).alias("lng"))
    three = lambda c: (F.floor(F.col(c) * 1e3 + 0.5) / 1e3).alias(c)
    return ops.snap_to_route(points, route, "s_suppkey").select("s_suppkey", "segment", three("off_m"), three("along_m"))


@query(f"""WITH {TRACKS_SQL}, j AS (SELECT *, CASE WHEN abs(lng - lag(lng) OVER w) > 180 THEN 1 ELSE 0 END AS jump FROM tracks WINDOW w AS (PARTITION BY craft ORDER BY ord)),
  p AS (SELECT *, sum(jump) OVER (PARTITION BY craft ORDER BY ord) AS part FROM j) SELECT craft, ord, CAST(part AS BIGINT) AS part FROM (SELECT *, count(*) OVER (PARTITION BY craft, part) AS n FROM p) WHERE n > 1""")
def win09_split(spark, sf):
    return ops.antimeridian_runs(tracks(spark, sf), "craft", "ord").select("craft", "ord", "part")


BARS = "bars AS (SELECT strftime(o_orderdate, '%Y-%m') AS bucket, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume FROM orders GROUP BY 1)"


def _bars(spark, sf):
    return ops.candles(table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM"), "o_orderkey", "o_totalprice", "o_totalprice")


@query(f"WITH {BARS} SELECT bucket, open, high, low, close, floor(volume * 1e2 + 0.5) / 1e2 AS volume FROM bars")
def src21_candles(spark, sf):
    return _bars(spark, sf).withColumn("volume", F.floor(F.col("volume") * 1e2 + 0.5) / 1e2)


@query(f"WITH {BARS} SELECT bucket, close, lag(close) OVER (ORDER BY bucket) AS previous, {r6('(close - lag(close) OVER (ORDER BY bucket)) / lag(close) OVER (ORDER BY bucket) * 100')} AS change_pct FROM bars")
def win10_change_pct(spark, sf):
    return ops.change_percent(_bars(spark, sf), "bucket").select("bucket", "close", "previous", R6(F.col("change_pct")).alias("change_pct"))


@query(f"""WITH c AS (SELECT event_id // 3 AS quote, event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN value END AS close FROM events),
  q AS (SELECT DISTINCT event_id // 3 AS quote FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY quote ORDER BY event_id DESC) AS nth FROM c WHERE close IS NOT NULL),
  p AS (SELECT quote, quote % 90 + 0.5e0 AS price, coalesce(close, quote % 4 + 0e0) AS previous FROM q LEFT JOIN (SELECT quote, close FROM n WHERE nth = 2) USING (quote))
  SELECT quote, price, previous, {r6('CASE WHEN previous <> 0 THEN (price - previous) / previous * 100 END')} AS change_pct FROM p""")
def win10_quote_changes(spark, sf):
    quote = F.floor(F.col("event_id") / 3).alias("quote")
    e = table(spark, sf, "events")
    closes = e.select(quote, "event_id", F.when(~F.col("event_type").isin("error", "click"), F.col("value")).alias("close"))
    number = F.col("quote")
    quotes = e.select(quote).distinct().select("quote", (number % 90 + 0.5).cast("double").alias("price"), (number % 4).cast("double").alias("fallback"))
    return ops.quote_changes(closes, quotes, "quote", "event_id").withColumn("change_pct", R6(F.col("change_pct")))


@query(f"""WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT user_id, n, value AS e FROM v WHERE n = 1 UNION ALL SELECT v.user_id, v.n, r.e * 0.75e0 + v.value * 0.25e0 FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1)
  SELECT user_id, {r6('arg_max(e, n)')} AS ewma FROM r GROUP BY user_id""")
def win11_ewma(spark, sf):
    return ops.ewma(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", R6(F.col("ewma")).alias("ewma"))


STREAK = """s0 AS (SELECT user_id, event_id, event_type NOT IN ('error', 'click') AS ok FROM events), s1 AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS wins FROM s0),
  s2 AS (SELECT *, CAST(sum((NOT ok)::INTEGER) OVER (PARTITION BY user_id, wins ORDER BY event_id) AS BIGINT) AS streak FROM s1)"""


@query(f"WITH {STREAK} SELECT user_id, event_id, streak, CASE WHEN streak >= 2 THEN least(900000, 60000 * CAST(pow(2, least(4, streak - 2)) AS BIGINT)) ELSE 0 END AS cooldown_ms FROM s2")
def win12_streaks(spark, sf):
    a = table(spark, sf, "events").select("user_id", "event_id", (~F.col("event_type").isin("error", "click")).alias("ok"))
    return ops.failure_streaks(a, "user_id", "event_id").select("user_id", "event_id", "streak", "cooldown_ms")


NOTES = """n0 AS (SELECT user_id, event_id, event_type <> 'error' AS ok, CASE WHEN event_id % 7 < 5 THEN event_id % 3 END AS items,
    CASE WHEN event_id % 5 < 4 THEN event_id % 2 END AS fresh FROM events),
  n1 AS (SELECT *, ok AND coalesce(items, 0) = 0 AS e, ok AND coalesce(items, 0) > 0 AS filled, coalesce(fresh = 0, false) AS s, coalesce(fresh > 0, false) AS lively FROM n0),
  n2 AS (SELECT *, count(*) FILTER (e) OVER w AS es, count(*) FILTER (s) OVER w AS ss FROM n1 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


# A streak is the running count less what it was at the last row that ended one.
@query(f"""WITH {NOTES} SELECT user_id, event_id, es - coalesce(max(CASE WHEN filled THEN es END) OVER w, 0) AS empty_streak,
  ss - coalesce(max(CASE WHEN lively THEN ss END) OVER w, 0) AS stale_streak FROM n2 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win12_content_streaks(spark, sf):
    e = F.col("event_id")
    notes = table(spark, sf, "events").select(
        "user_id", "event_id", (F.col("event_type") != "error").alias("ok"), F.when(e % 7 < 5, e % 3).alias("items"), F.when(e % 5 < 4, e % 2).alias("fresh"),
    )
    return ops.content_streaks(notes, "user_id", "event_id").select("user_id", "event_id", "empty_streak", "stale_streak")


@query(f"""WITH h AS (SELECT user_id, avg((event_type <> 'error')::INTEGER) AS rate, count(*) % 6 AS empty, count(*) % 8 AS stale, count(*) % 4 AS fails FROM events GROUP BY user_id)
  SELECT user_id, {r6("greatest(0.35e0, least(1.05e0, CASE WHEN rate < 0.95 THEN 0.92e0 ELSE 1 END * CASE WHEN rate < 0.8 THEN 0.82e0 ELSE 1 END * CASE WHEN rate < 0.6 THEN 0.72e0 ELSE 1 END * CASE WHEN empty >= 2 THEN 0.88e0 ELSE 1 END * CASE WHEN empty >= 4 THEN 0.75e0 ELSE 1 END * CASE WHEN stale >= 3 THEN 0.9e0 ELSE 1 END * CASE WHEN stale >= 6 THEN 0.75e0 ELSE 1 END * CASE WHEN fails > 0 THEN greatest(0.55e0, 1 - fails * 0.12e0) ELSE 1 END * CASE WHEN fails >= 2 THEN 0.5e0 ELSE 1 END))")} AS multiplier FROM h""")
def win13_health(spark, sf):
    n = F.count("*")
    h = table(spark, sf, "events").groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("int")).alias("rate"), (n % 6).alias("empty"), (n % 8).alias("stale"), (n % 4).alias("fails"))
    m = ops.health_multiplier(F.col("rate"), F.col("empty"), F.col("stale"), F.col("fails"), F.col("fails") >= 2)
    return h.select("user_id", R6(m).alias("multiplier"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 100")
def win14_rolling_log(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf, "events").withColumn("n", nth).where("n <= 100").select("user_id", "event_id")


@query(f"""WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
  SELECT user_id, {r6('coalesce(sum(step) FILTER (step > 1), 0)')} AS ascent, {r6('coalesce(-sum(step) FILTER (step < -1), 0)')} AS descent FROM d GROUP BY user_id""")
def agg20_ascent(spark, sf):
    a = ops.ascent_descent(table(spark, sf, "events"), "user_id", "event_id", "value")
    return a.select("user_id", R6(F.col("ascent")).alias("ascent"), R6(F.col("descent")).alias("descent"))


# Snapshots and state

DAY = "CAST(epoch_us(ts) // 86400000000 AS BIGINT)"


def _days(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))


@query(f"""WITH m AS (SELECT DISTINCT event_type AS layer, user_id, {DAY} AS day FROM events), b AS (SELECT min(day) AS lo, max(day) AS hi FROM m), e AS (
    SELECT a.layer, a.user_id, a.day, 'enter' AS event FROM m a WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.layer = a.layer AND p.user_id = a.user_id AND p.day = a.day - 1)
    UNION ALL SELECT a.layer, a.user_id, a.day + 1, 'exit' FROM m a WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.layer = a.layer AND p.user_id = a.user_id AND p.day = a.day + 1))
  SELECT e.* FROM e, b WHERE day > lo AND day <= hi""")
def set02_tripwire(spark, sf):
    return state.tripwire(_days(spark, sf).withColumnRenamed("event_type", "layer"), ["layer", "user_id"], "day").select("layer", "user_id", "day", "event")


@query(f"""WITH d AS (SELECT user_id, {DAY} - 19723 AS day, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT * FROM d WHERE day = 5), b AS (SELECT * FROM d WHERE day = 6)
  SELECT user_id, CASE WHEN a.n IS NULL THEN 'entered' WHEN b.n IS NULL THEN 'exited' ELSE 'changed' END AS change FROM a FULL JOIN b USING (user_id) WHERE a.n IS DISTINCT FROM b.n""")
def set04_snapshot_diff(spark, sf):
    d = _days(spark, sf).groupBy("user_id", (F.col("day") - 19723).alias("day")).agg(F.count("*").alias("n"))
    return state.snapshot_diff(d.where("day = 5"), d.where("day = 6"), ["user_id"], "n")


@query("SELECT event_id, event_type FROM events WHERE event_id > 9000")
def set03_new_since(spark, sf):
    return table(spark, sf, "events").where("event_id > 9000").select("event_id", "event_type")


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)")
def set06_watchlist_missing(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(rich, "n_nationkey", "left_anti").select("n_name")


@query("SELECT (SELECT count(*) FROM orders) = (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) AS covered")
def set07_partition_coverage(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    parts = o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus <> 'F'"))
    return spark.createDataFrame([(state.same_multiset(o, parts),)], "covered boolean")


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def set08_edge_dedup(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line"))


@query("""WITH r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS "at", CASE WHEN event_type <> 'error' THEN event_type END AS content FROM events),
  e AS (SELECT *, "at" + CASE WHEN content IS NULL THEN 600000 ELSE 21600000 END AS ends FROM r),
  g AS (SELECT *, coalesce("at" > lag(ends) OVER w, true) AS fresh, lead("at") OVER w AS next, lag(content) OVER w AS said FROM e WINDOW w AS (PARTITION BY key ORDER BY "at", content NULLS FIRST)),
  k AS (SELECT *, CASE WHEN fresh THEN 'arrival' WHEN content IS DISTINCT FROM said THEN 'update' END AS kind, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY "at", content NULLS FIRST ROWS UNBOUNDED PRECEDING) AS life FROM g),
  c AS (SELECT *, count(kind) OVER (PARTITION BY key, life ORDER BY "at", content NULLS FIRST ROWS UNBOUNDED PRECEDING) AS n FROM k)
  SELECT key, "at", kind, n FROM c WHERE kind IS NOT NULL UNION ALL SELECT key, ends, 'retirement', n FROM c WHERE coalesce(next > ends, ends < (SELECT max("at") FROM r))""")
def str08_presence(spark, sf):
    """Users as they come, change what they do and go: present for six hours after an event, ten minutes after an error."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("what"))
    return state.presence(e, "user", "at_ms", "what", 6 * 3_600_000, 600_000)


@query(f"""WITH e AS (SELECT user_id, {DAY} AS day, CAST(max(event_id) % 3 AS VARCHAR) AS content FROM events GROUP BY 1, 2), c AS (SELECT *, lag(content) OVER w AS b, row_number() OVER w AS nth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)),
  d AS (SELECT * FROM c WHERE nth = 1 OR content IS DISTINCT FROM b) SELECT user_id, day, content, row_number() OVER (PARTITION BY user_id ORDER BY day) AS revision, row_number() OVER (ORDER BY day, user_id) AS cursor FROM d""")
def snk01_revisions(spark, sf):
    e = _days(spark, sf).groupBy("user_id", "day").agg((F.max("event_id") % 3).cast("string").alias("content"))
    return state.revisions(e, "user_id", "day", "content").select("user_id", "day", "content", "revision", "cursor")


@query("""WITH a AS (SELECT 'user:' || user_id AS identity, max(event_id) % 5 AS c FROM events WHERE day(ts) <= 15 GROUP BY 1), b AS (SELECT 'user:' || user_id AS identity, max(event_id) % 5 AS c FROM events GROUP BY 1),
  n AS (SELECT *, row_number() OVER (ORDER BY identity) AS cursor FROM a),
  m AS (SELECT b.identity, a.c IS NULL AS added, b.c AS content, a.c IS DISTINCT FROM b.c AS changed, n.cursor AS was FROM b LEFT JOIN a USING (identity) LEFT JOIN n USING (identity)),
  k AS (SELECT identity, row_number() OVER (ORDER BY identity) + (SELECT count(*) FROM a) AS cursor FROM m WHERE changed)
  SELECT identity, 'content ' || content AS payload, CASE WHEN changed AND NOT added THEN 2 ELSE 1 END AS revision, coalesce(k.cursor, was) AS cursor, changed FROM m LEFT JOIN k USING (identity)""")
def snk01_commit_log(spark, sf):
    """Every user's content of half a month, then of the whole, as two batches of one log; the second is sent twice."""
    folder = f"{shared_folder(spark).rstrip('/')}/commits-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    content = lambda rows: rows.groupBy(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("identity")).agg(F.concat(F.lit("content "), (F.max("event_id") % 5).cast("string")).alias("payload"))
    as_writes = lambda rows, expected: rows.select(F.array("identity").alias("identities"), "payload", expected.alias("expected_revision"))
    half, whole = content(e.where(F.dayofmonth("ts") <= 15)), content(e)
    first = commits.commit(spark, folder, "half", as_writes(half, F.lit(None).cast("long")))
    known = first.select("identity", F.col("revision").alias("known"))
    second = as_writes(whole.join(known, "identity", "left"), F.col("known"))
    commits.commit(spark, folder, "whole", second)
    again = commits.commit(spark, folder, "whole", second)
    return again.join(commits.current_events(spark, folder).select("event_id", "payload"), "event_id").select("identity", "payload", "revision", "cursor", "changed")


@query("""WITH a AS (SELECT 'user:' || user_id AS identity, max(event_id) % 5 AS c FROM events WHERE day(ts) <= 15 GROUP BY 1), b AS (SELECT 'user:' || user_id AS identity, max(event_id) % 5 AS c FROM events GROUP BY 1),
  n AS (SELECT *, row_number() OVER (ORDER BY identity) AS cursor FROM a), m AS (SELECT b.identity, a.c IS NULL AS added, b.c AS content, a.c IS DISTINCT FROM b.c AS changed, n.cursor AS was FROM b LEFT JOIN a USING (identity) LEFT JOIN n USING (identity)),
  k AS (SELECT identity, row_number() OVER (ORDER BY identity) + (SELECT count(*) FROM a) AS cursor FROM m WHERE changed)
  SELECT identity, 'content ' || content AS payload, CASE WHEN changed AND NOT added THEN 2 ELSE 1 END AS revision, coalesce(k.cursor, was) AS cursor, CASE WHEN (SELECT count(*) FROM k) > 6000 THEN 'bootstrap' ELSE 'changes' END AS how FROM m LEFT JOIN k USING (identity)""")
def str07_log_sync(spark, sf):
    """A client that has every user's content of half a month, brought up to date with the log of the whole."""
    folder = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    named = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    content = lambda rows: rows.groupBy(named.alias("identity")).agg(F.concat(F.lit("content "), (F.max("event_id") % 5).cast("string")).alias("payload"))
    first = commits.commit(spark, folder, "half", content(e.where(F.dayofmonth("ts") <= 15)).select(F.array("identity").alias("identities"), "payload", F.lit(None).cast("long").alias("expected_revision")))
    have, token = replay.bootstrap(spark, folder)
    known = first.select("identity", F.col("revision").alias("expected_revision"))
    commits.commit(spark, folder, "whole", content(e).join(known, "identity", "left").select(F.array("identity").alias("identities"), "payload", "expected_revision"))
    now, _, how = replay.synchronise(spark, folder, have, token)
    return now.join(commits.current_identities(spark, folder), "event_id").select("identity", "payload", "revision", "cursor", F.lit(how).alias("how"))


@query(f"""WITH {SIGNALS_SQL}, m AS (SELECT max(occurred_ms) AS top FROM signals), l AS (SELECT source, url_key, max(occurred_ms) AS occurred_ms FROM signals GROUP BY 1, 2) SELECT l.* FROM l, m WHERE occurred_ms > top - 172800000""")
def snk02_signal_upsert(spark, sf):
    s = signals(spark, sf).select("source", "url_key", "occurred_ms")
    top = s.agg(F.max("occurred_ms").alias("t")).first().t or 0
    return state.upsert_latest(s.where("url_key % 2 = 0"), s.where("url_key % 2 = 1"), ["source", "url_key"], "occurred_ms", top)


@query("""SELECT user_id % 50 AS event_key, sha256('src' || (user_id % 7) || '|' || event_type) AS evidence_key, arg_max(value, event_id) AS payload FROM events GROUP BY 1, 2""")
def snk03_evidence_upsert(spark, sf):
    k = F.sha2(F.concat_ws("|", F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")), "event_type"), 256)
    return table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("event_key"), k.alias("evidence_key")).agg(F.max_by("value", "event_id").alias("payload"))


@query(f"""WITH e AS (SELECT user_id, {DAY} AS day, max(event_id) % 3 AS content FROM events WHERE user_id % 4 <> 0 OR {DAY} % 5 < 2 GROUP BY 1, 2),
  g AS (SELECT *, coalesce(day - lag(day) OVER w > 2, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)), l AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY day) AS life FROM g),
  c AS (SELECT *, CASE WHEN fresh THEN 'new' WHEN content IS DISTINCT FROM lag(content) OVER (PARTITION BY user_id, life ORDER BY day) THEN 'updated' ELSE 'ongoing' END AS lifecycle FROM l),
  q AS (SELECT user_id, day, row_number() OVER (ORDER BY day, user_id) AS seq FROM c WHERE lifecycle <> 'ongoing')
  SELECT c.user_id, c.day, lifecycle, CAST(sum((lifecycle = 'updated')::INTEGER) OVER (PARTITION BY c.user_id, life ORDER BY c.day) AS BIGINT) AS update_count, min(c.day) OVER (PARTITION BY c.user_id, life ORDER BY c.day) AS first_seen,
    max(seq) OVER (PARTITION BY c.user_id ORDER BY c.day) AS change_sequence FROM c LEFT JOIN q USING (user_id, day)""")
def str01_ledger(spark, sf):
    e = _days(spark, sf).where("user_id % 4 <> 0 OR day % 5 < 2").groupBy("user_id", "day").agg((F.max("event_id") % 3).alias("content"))
    return state.ledger(e, "user_id", "day", "content", 2)


@query(f"""WITH {SIGNALS_SQL}, m AS (SELECT max(occurred_ms) AS top FROM signals), l AS (SELECT user_id, max(occurred_ms) AS occurred_ms, arg_max(category, ord) AS category FROM signals GROUP BY 1) SELECT l.* FROM l, m WHERE occurred_ms >= top - 43200000""")
def str10_last_known(spark, sf):
    s = signals(spark, sf).select("user_id", "occurred_ms", "category")
    top = s.agg(F.max("occurred_ms").alias("t")).first().t or 0
    return state.last_known(s, "user_id", "occurred_ms", top, 43_200_000)


@query(f"""WITH RECURSIVE {SIGNALS_SQL}, w AS (SELECT source, min(occurred_ms) AS start FROM signals GROUP BY source
    UNION ALL SELECT w.source, min(s.occurred_ms) FROM w JOIN signals s ON s.source = w.source AND s.occurred_ms > w.start + 3600000 GROUP BY w.source)
  SELECT s.ord, row_number() OVER (PARTITION BY s.source, w.start ORDER BY s.occurred_ms, s.ord) <= 2 AS allowed FROM signals s ASOF JOIN w ON s.source = w.source AND s.occurred_ms >= w.start""")
def str12_rate_limit(spark, sf):
    return state.rate_limit(signals(spark, sf), "source", "occurred_ms", "ord", 2, 3_600_000).select("ord", "allowed")


@query(f"WITH {SIGNALS_SQL} SELECT id, sha256('[' || severity || ',' || url_key || ']') AS h FROM signals".replace("'[' || severity || ',' || url_key || ']'", """'{"category":"' || category || '","severity":' || severity || ',"url_key":' || url_key || '}'"""))
def sca25_content_hash(spark, sf):
    return signals(spark, sf).select("id", state.content_hash("url_key", "severity", "category").alias("h"))


@query("""WITH h AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid,
  rtrim(replace(replace(to_base64(encode('{"epoch":1,"cursor":' || o_orderkey || '}')), '+', '-'), '/', '_'), '=') AS token FROM h""")
def sca26_tokens_and_uuid(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", state.deterministic_uuid(k.cast("string")).alias("uuid"), state.cursor_token(F.lit(1), k).alias("token"))


# Identity

@query("""WITH l AS (SELECT DISTINCT l_orderkey % 4000 AS candidate, l_partkey % 1500 AS stored FROM lineitem), i AS (SELECT candidate, count(DISTINCT stored) AS n, min(stored) AS id FROM l GROUP BY 1),
  r AS (SELECT candidate, n, CASE WHEN n = 1 THEN row_number() OVER (PARTITION BY CASE WHEN n = 1 THEN id END ORDER BY candidate) END AS k FROM i) SELECT candidate, CASE WHEN n > 1 THEN 'multiple' WHEN k > 1 THEN 'repeated' ELSE 'accepted' END AS verdict FROM r""")
def idr01_conflicts(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 4000).alias("candidate"), (F.col("l_partkey") % 1500).alias("stored"))  # noqa: E741
    return state.identity_conflicts(l.withColumn("at", F.col("candidate")), "candidate", "stored", "at")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT 's:' || l_partkey AS a, 'c:' || (l_suppkey * 7 + l_partkey % 31) AS b FROM lineitem), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a AS n, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n), m AS (SELECT n, min(root) AS component FROM r GROUP BY n),
  k AS (SELECT component, count(*) FILTER (n LIKE 's:%') AS stored, count(*) FILTER (n LIKE 'c:%') AS current FROM m GROUP BY component)
  SELECT *, CASE WHEN stored = 1 AND current = 1 THEN 'consistent' WHEN stored = 1 THEN 'split' WHEN current = 1 THEN 'merge' ELSE 'overlap' END AS kind FROM k""")
def idr04_components(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("stored"), (F.col("l_suppkey") * 7 + F.col("l_partkey") % 31).alias("current")).distinct()  # noqa: E741
    return state.match_components(l, "stored", "current")


IP = "(event_id * 2654435761) % 4294967296"


@query(f"""WITH n AS (SELECT event_id, {IP} AS n FROM events), o AS (SELECT *, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM n)
  SELECT event_id, a || '.' || b || '.' || c || '.' || d AS ip, n, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR a >= 224 AS private, n - n % 256 AS subnet FROM o""")
def sca19_ipv4(spark, sf):
    n = (F.col("event_id") * 2654435761) % 4294967296
    e = table(spark, sf, "events").select("event_id", net.number_ipv4(n).alias("ip")).withColumn("o", net.ipv4_octets(F.col("ip")))
    e = e.withColumn("n", net.ipv4_number(F.col("o")))
    return e.select("event_id", "ip", "n", net.is_private(F.col("o")).alias("private"), net.subnet_start(F.col("n"), 24).alias("subnet"))


