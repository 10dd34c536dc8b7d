"""Identity reconciliation, durable-store joins, exports and route checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.geo import KM_PER_DEGREE, haversine_km, round_half_up
from strandline.operators.spatial import _cells

HOUR = 3_600_000


def identity_lookup(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """``candidate, stored``: the distinct stored events that any identity (``source_id, upstream_id``) of a candidate names, in order."""
    met = candidates.join(identities, ["source_id", "upstream_id"]).groupBy("candidate", "event_id").agg(F.min("ord").alias("ord"))
    return met.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("ord", "event_id"))).alias("m")).select("candidate", F.transform("m", lambda x: x["event_id"]).alias("stored"))


def last_revisions(revisions: DataFrame, key: str, cursor: str, most: int = 3) -> DataFrame:
    """The newest ``most`` cursors of every key, newest first."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(cursor)))
    top = revisions.withColumn("n", nth).where(F.col("n") <= most)
    return top.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(cursor))).alias("cursors"))


def unchanged_refresh(stored: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Writes against stored rows (``content, seen_ms``): equal ones only move ``seen_ms`` on, others need a revision."""
    old = stored.select(key, F.col("content").alias("old"), F.col("seen_ms").alias("old_seen"))
    j = writes.join(old, key, "left")
    same = F.coalesce(F.col("old") == F.col("content"), F.lit(False))
    return j.select(key, F.when(same, "refresh").when(F.col("old").isNull(), "insert").otherwise("revise").alias("action"), F.greatest("seen_ms", "old_seen").alias("seen_ms"))


def split_plan(links: DataFrame, observations: DataFrame) -> DataFrame:
    """What to do with each stored event, given which provider ids its identities were seen with.

    Links have ``event_id, source_id, upstream_id, revision``; observations ``source_id, upstream_id, provider`` with a
    null provider where it can't be told. A split is proposed if nothing blocks it and there are several providers.
    """
    seen = observations.groupBy("source_id", "upstream_id").agg(F.collect_set("provider").alias("providers"), F.bool_or(F.col("provider").isNull()).alias("unknown"))
    j = links.join(seen, ["source_id", "upstream_id"], "left")
    reason = (
        F.when(F.col("providers").isNull(), "identity_not_in_retained_signals")
        .when(F.col("unknown"), F.when(F.col("source_id").startswith("news:"), "news_identity_requires_content_review").otherwise("provider_id_unverified"))
        .when(F.size("providers") != 1, "identity_shared_by_distinct_provider_ids")
    )
    j = j.withColumn("reason", reason).withColumn("provider", F.when(F.col("reason").isNull(), F.col("providers")[0])).withColumn("provider_source", F.when(F.col("reason").isNull(), F.col("source_id")))
    g = j.groupBy("event_id").agg(
        F.count("*").alias("identities"), F.collect_set("reason").alias("reasons"), F.count_distinct("provider").alias("partitions"), F.count_distinct("provider_source").alias("sources"), F.count_distinct("revision").alias("revisions"),
    )
    blockers = F.array_sort(F.concat("reasons", F.array_compact(F.array(F.when(F.col("sources") > 1, "cross_provider_correspondence_requires_review"), F.when(F.col("revisions") != 1, "inconsistent_revision")))))
    g = g.withColumn("blockers", blockers)
    return g.select("event_id", "identities", "partitions", F.array_join("blockers", ",").alias("blockers"), F.when((F.size("blockers") == 0) & (F.col("partitions") > 1), "propose_split_for_review").otherwise("manual_review").alias("action"))


#: Members of one row of reports alike, and tasks that such rows meet in.
ALIKE_MEMBERS, MEETING_TASKS = 256, 192


def nearby_members(members: DataFrame, km: float = 25.0) -> DataFrame:
    """The closest pair of observations of each two members of the same category that are near in place and time.

    Members have ``member, category, at_ms, lat, lng``. Observations of the same time and place are one row, so that such
    rows meet once and the pairs of two rows, of the same distance, stand together.  Blocked by time bucket and grid cell,
    the later row on the right, so that two rows meet once; an earthquake pair may lie 15 minutes apart, a wildfire pair a
    day.  Only pairs with a member of several observations are grouped.
    """
    near = F.when(F.col("category") == "earthquake", HOUR // 4).when(F.col("category") == "wildfire", 24 * HOUR)
    m = members.withColumn("span", near).where("span IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    several = m.groupBy("member").agg((F.count("*") > 1).alias("several")).where("several")
    m = m.join(several, "member", "left").withColumn("several", F.col("several").isNotNull())
    alike = ["category", "at_ms", "lat", "lng", "several"]
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("member"))
    m = m.withColumn("nth", F.floor((nth - 1) / ALIKE_MEMBERS)).groupBy(*alike, "nth", "span").agg(F.array_sort(F.collect_list("member")).alias("members"))
    m = m.withColumn("slot", F.floor(F.col("at_ms") / F.col("span")))
    size = 2 ** math.ceil(math.log2(km / KM_PER_DEGREE))
    around = int(360 / size)
    own = F.floor((F.col("lat") + 90) / size).cast("int") * around + F.pmod(F.floor((F.col("lng") + 180) / size).cast("int"), F.lit(around))
    a = m.withColumn("cell", own).withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    b = m.withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lng"), km * 1.01, size)))
    a, b = (side.repartition(MEETING_TASKS, "category", "slot", "cell").hint("merge").alias(name) for side, name in ((a, "a"), (b, "b")))
    d = haversine_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    end = lambda x: f"struct({x}.at_ms, {x}.lat, {x}.lng, {x}.several, {x}.nth)"
    later = F.expr(f"{end('a')} <= {end('b')} AND b.at_ms - a.at_ms <= a.span")
    met = a.join(b, F.expr("a.category = b.category AND a.slot = b.slot AND a.cell = b.cell") & later & (d <= km))
    rows = met.select(
        d.alias("km"), ((F.col("b.at_ms") - F.col("a.at_ms")) / 1000).alias("seconds"), (F.col("a.several") | F.col("b.several")).alias("several"),
        F.expr(f"{end('a')} = {end('b')}").alias("itself"), F.col("a.members").alias("one"), F.col("b.members").alias("other"))
    each = rows.withColumn("one", F.explode("one")).withColumn("other", F.explode("other")).where("one <> other AND (NOT itself OR one < other)")
    pairs = each.select(F.least("one", "other").alias("left"), F.greatest("one", "other").alias("right"), "km", "seconds", "several")
    grouped = pairs.where("several").groupBy("left", "right").agg(F.min(F.struct("km", "seconds")).alias("m")).select("left", "right", "m.km", "m.seconds")
    if several.isEmpty():
        return pairs.drop("several")
    return pairs.where("NOT several").drop("several").union(grouped)


def history_context(links: DataFrame, history: DataFrame) -> DataFrame:
    """How much the revisions of an event (``event_id, revision, title, keys``) say about each of its identities (``event_id, key``)."""
    h = history.select("event_id", "title", F.size(F.array_distinct("keys")).alias("n"), F.explode(F.array_distinct("keys")).alias("key"))
    c = h.groupBy("event_id", "key").agg(F.count("*").alias("contexts"), F.count_if(F.col("n") == 1).alias("single"), F.count_distinct(F.when(F.col("n") == 1, F.col("title"))).alias("titles"))
    status = (
        F.when(F.col("contexts").isNull(), "missing_history").when(F.col("single") == 0, "composite_context_only").when(F.col("titles") > 1, "multiple_singleton_titles").otherwise("singleton_context_available")
    )
    return links.join(c, ["event_id", "key"], "left").select("event_id", "key", status.alias("status"))


def apply_split(identities: DataFrame, targets: DataFrame) -> DataFrame:
    """Identities after an approved split: moved to their target event, others where they were (``key, event_id``)."""
    t = targets.select("key", F.col("event_id").alias("target"))
    return identities.join(t, "key", "left").select("key", F.coalesce("target", "event_id").alias("event_id"))


def split_covers(identities: DataFrame, targets: DataFrame, event: str) -> bool:
    """Whether a split names every identity of the event once and no other."""
    own = identities.where(F.col("event_id") == event).select("key")
    return own.exceptAll(targets.select("key")).isEmpty() and targets.select("key").exceptAll(own).isEmpty()


def on_corridor(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Whether a place lies near the great circle between two others."""
    return haversine_km(lat1, lng1, lat, lng) + haversine_km(lat, lng, lat2, lng2) <= 1.15 * haversine_km(lat1, lng1, lat2, lng2) + 150


def plausible_route(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d = haversine_km(lat1, lng1, lat2, lng2)
    return (d >= 30) & ~((haversine_km(lat, lng, lat1, lng1) > 1.5 * d) & (haversine_km(lat, lng, lat2, lng2) > 1.5 * d))


def merge_providers(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Field by field what the first provider says, else the second; empty text counts as nothing."""
    rest = [c for c in a.columns if c != key]
    kinds = dict(a.dtypes)
    said = lambda side, c: F.nullif(F.col(f"{side}.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"{side}.{c}")
    j = a.alias("a").join(b.alias("b"), F.expr(f"a.{key} = b.{key}"), "full")
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(said("a", c), said("b", c)).alias(c) for c in rest])


def feature_rows(rows: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON features as text, a row each; rows without coordinates are left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.to_json(feature).alias("feature"))


def arrivals(rows: DataFrame, at: str, now_ms: int, window_ms: int = 60_000) -> DataFrame:
    """Recent arrivals with their age as a share of the window."""
    age = (F.lit(now_ms) - F.col(at)) / window_ms
    return rows.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") < 1))


def fallback_regions(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Regions to try when a request (``request, region, position, empty``) found nothing: neighbours in order, not asked for already."""
    want = requests.where("empty")
    n = want.join(edges, "region").select("request", "neighbour", "position", "rank")
    n = n.join(want.select("request", F.col("region").alias("neighbour")), ["request", "neighbour"], "left_anti")
    first = n.groupBy("request", "neighbour").agg(F.min(F.struct("position", "rank")).alias("o"))
    return first.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("o", "neighbour"))).alias("f")).select("request", F.array_join(F.transform("f", lambda x: x["neighbour"]), ",").alias("fallback"))


def control_verified(positives: DataFrame, controls: DataFrame, site: str) -> DataFrame:
    """Positive answers of sites that don't answer positively to a made-up name as well."""
    return positives.join(controls.select(site).distinct(), site, "left_anti")


def air_quality_band(pm25: Column) -> Column:
    return F.when(pm25 > 150, "Hazardous").when(pm25 > 100, "Unhealthy").when(pm25 > 55, "Unhealthy (Sensitive)").when(pm25 > 35, "Moderate").otherwise("Good")


def reputation(proxy: Column, hosting: Column) -> Column:
    return F.when(proxy, "HIGH").when(hosting, "MEDIUM").otherwise("LOW")


def coin_direction(address: Column, vin: Column, vout: Column) -> Column:
    """``struct<direction, value, counterparty>`` of a transaction (arrays of ``struct<address, value>``) as one address sees it.

    Values in hundred-millionths; the counterparty is the largest party on the other side.
    """
    side = lambda legs: F.aggregate(F.filter(legs, lambda x: x["address"] == address), F.lit(0.0), lambda a, x: a + x["value"]) / 1e8
    spent, got = side(vin), side(vout)
    direction = F.when((spent > 0) & (got > 0), "self").when(spent > 0, "out").when(got > 0, "in").otherwise("unknown")
    largest = lambda legs: F.array_max(F.transform(F.filter(legs, lambda x: x["address"] != address), lambda x: F.struct(x["value"], x["address"])))["address"]
    return F.struct(direction.alias("direction"), F.when(direction == "out", spent - got).otherwise(got).alias("value"), F.when(direction == "out", largest(vout)).otherwise(largest(vin)).alias("counterparty"))


def next_manoeuvre(steps: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """Per position (``along_m, off_m``): off the route, arrived, or the first step more than a metre ahead.

    Steps have ``route_id, step, at_m``; the last step is the arrival.
    """
    end = steps.groupBy("route_id").agg(F.max("at_m").alias("end_m"))
    ahead = positions.join(steps, "route_id").where(F.col("at_m") > F.col("along_m") + 1).groupBy(key).agg(F.min_by("step", "at_m").alias("next_step"), F.min("at_m").alias("next_at"))
    p = positions.join(end, "route_id").join(ahead, key, "left")
    state = F.when(F.col("off_m") > 45, "off_route").when(F.col("end_m") - F.col("along_m") <= 30, "arrived").otherwise("on_route")
    band = F.when(F.col("next_at") - F.col("along_m") <= 40, "now").when(F.col("next_at") - F.col("along_m") <= 200, "near").when(F.col("next_at") - F.col("along_m") <= 800, "soon")
    return p.select(key, state.alias("state"), "next_step", round_half_up(F.col("next_at") - F.col("along_m")).alias("in_m"), band.alias("band"))


def announcements(progress: DataFrame, key: str, order: str) -> DataFrame:
    """Progress rows where a band of a step (``next_step, band``) is entered for the first time."""
    nth = F.row_number().over(Window.partitionBy(key, "next_step", "band").orderBy(order))
    return progress.where("band IS NOT NULL").withColumn("n", nth).where("n = 1").drop("n")


def decode_polyline(encoded: str | None, precision: int = 5) -> list[tuple[float, float]]:
    """Longitudes and latitudes of an encoded polyline; a cut-off last number is left out."""
    numbers, value, shift = [], 0, 0
    for c in encoded or "":
        part = ord(c) - 63
        value |= (part & 31) << shift
        shift += 5
        if part < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    out, lat, lng = [], 0, 0
    for dlat, dlng in zip(numbers[::2], numbers[1::2]):
        lat, lng = lat + dlat, lng + dlng
        out.append((lng / 10**precision, lat / 10**precision))
    return out


def polyline_points(column: Column, precision: int = 5) -> Column:
    """``array<struct<lng, lat>>`` of encoded polylines; bits are sequential, so this runs on Arrow batches."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())]))
    return F.arrow_udf(lambda t: pa.array([[{"lng": x, "lat": y} for x, y in decode_polyline(s, precision)] for s in t.to_pylist()], kind), "array<struct<lng:double,lat:double>>")(column)


def review_holds(plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """Planned actions (``event_id, action``) after the pairs (``left, right``) that a review found: both sides go to manual review."""
    held = pairs.select(F.col("left").alias("event_id")).union(pairs.select("right")).distinct().withColumn("held", F.lit(True))
    return plan.join(held, "event_id", "left").select("event_id", F.when(F.col("held"), "manual_review").otherwise(F.col("action")).alias("action"), F.coalesce("held", F.lit(False)).alias("held"))


def snapshot_checksum(rows: DataFrame, *by: str) -> DataFrame:
    """The count and an order-free SHA-256 of all rows, repeats counted: one row, or one for each value of ``by``.

    Each row's digest is cut into eight 32-bit numbers, which are summed over all rows; the checksum is the digest of the
    sums.  Rows enter as JSON of their other columns in order of name, nulls included.  No rows: the digest of eight zeros,
    or no row with ``by``.
    """
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns) if c not in by]
    digest = rows.select(*by, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    words = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(30,0)") for i in range(8)]
    return digest.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *[w.cast("string") for w in words]), 256).alias("checksum"))


#: Degrees within which two places of one name are the same, score from which a secondary one is prominent, and places a request gets.
SAME_DEGREES, PROMINENT, MOST_PLACES = 0.001, 0.5, 8


def merged_places(candidates: DataFrame, request: str = "request", most: int = MOST_PLACES) -> DataFrame:
    """``request, nth, name, lat, lng`` of the places that a request for a place gets from two providers.

    Candidates have ``request, secondary`` (of the second provider), ``rank`` (the provider's order), ``score, name, lat, lng``.
    Prominent secondary ones come first, by falling score, then primary ones, then the other secondary ones in their order; a
    place within 0.001 degrees both ways of a kept one of the same name, whatever its case, is left out; then the first ones
    stay.  A request's candidates are the few that two providers return, so its fold is one short list; requests are spread.

    Null names are equal to the empty one; a candidate without a place is left out; a null score is not prominent; ties go by
    rank, then by name; a null request is a request of its own.
    """
    prominent = F.col("secondary") & (F.coalesce("score", F.lit(0.0)) >= PROMINENT)
    group = F.when(prominent, 0).when(~F.col("secondary"), 1).otherwise(2)
    row = F.struct(group.alias("group"), F.when(prominent, -F.col("score")).otherwise(F.lit(0.0)).alias("less"), "rank", F.coalesce("name", F.lit("")).alias("name"), "lat", "lng")
    same = lambda x, y: (F.lower(x.getField("name")) == F.lower(y.getField("name"))) & (F.abs(x.getField("lat") - y.getField("lat")) < SAME_DEGREES) & (F.abs(x.getField("lng") - y.getField("lng")) < SAME_DEGREES)
    listed = candidates.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(request).agg(F.array_sort(F.collect_list(row)).alias("all"))
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return listed.select(request, F.posexplode(F.slice(fold, 1, most)).alias("nth", "p")).select(request, "nth", "p.name", "p.lat", "p.lng")


# What a risk at a chokepoint means for prices (fixed values).
CHOKEPOINTS = {"Strait of Hormuz": "crude price spike", "Suez Canal": "European supply delays", "Panama Canal": "LNG and agriculture delays"}


def supply_alerts(chokepoints: DataFrame) -> DataFrame:
    """``name, risk, alert`` of chokepoints at high or critical risk that move prices."""
    meaning = F.create_map(*[F.lit(x) for kv in CHOKEPOINTS.items() for x in kv])[F.col("name")]
    return chokepoints.where(F.col("risk").isin("HIGH", "CRITICAL")).withColumn("alert", meaning).where("alert IS NOT NULL")


def file_stats(frame: DataFrame) -> DataFrame:
    """Rows and bytes of each file behind a frame, without reading its columns."""
    return frame.select("_metadata.file_name", "_metadata.file_size").groupBy("file_name").agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))
