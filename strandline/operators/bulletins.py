"""News pages, bulletins and reviews: blocks of a page, news as signals, dated lists, digests and the holds of past reviews."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions import text
from strandline.operators.graph import connected_components

# Sources by name, longest title, least text of a block, longest publication window in days, reasons that a past review may give.
OSINT_SOURCES = ("Conflict Intelligence Team", "WarTranslated", "NOELREPORTS", "Faytuks Network", "Liveuamap")
BROADCASTERS = ("BBC", "Al Jazeera", "Euronews")
NOT_INDEPENDENT = ("BBC", "Al Jazeera", "Euronews", "Liveuamap")
TITLE_CHARS, BLOCK_CHARS, MOST_DAYS = 160, 20, 119
PAIR_REASONS = ("nearby_provider_events_require_review", "possible_cross_provider_confirmation")
PAIR_FIELDS = ("left_event", "right_event", "left_provider", "right_provider", "reason")
DAY_MS = 86_400_000


def page_blocks(pages: DataFrame, html: str, marker: str, ending: str) -> DataFrame:
    """The message blocks of each page: the page's other columns with ``place, title, description``.

    A block begins at ``marker`` and its text ends before the next ``ending``; what comes before the first marker, blocks
    without an end and texts of under 20 characters are left out.  The title is the first sentence or line, of at most 160
    characters.  A null page has no blocks.
    """
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    cut = pages.select(*others, F.posexplode(F.split(F.col(html), re.escape(marker))).alias("place", "block")).where("place > 0")
    said = cut.where(F.col("block").contains(ending)).withColumn("description", text.decode_html(F.substring_index("block", ending, 1)))
    first = F.split("description", r"\n|(?<=[.!?])\s+", 2)[0]
    first = F.when(first == "", F.col("description")).otherwise(first)
    title = F.when(F.length(first) > TITLE_CHARS, F.concat(F.substring(first, 1, TITLE_CHARS - 3), F.lit("..."))).otherwise(first)
    return said.where(F.length("description") >= BLOCK_CHARS).withColumn("title", title).drop("block")


def per_source(items: DataFrame, source: str, order: list[str], most: int | Column, last: bool = False) -> DataFrame:
    """The first (or last) ``most`` items of each source in the order of the columns ``order``; a null source is a source."""
    by = [F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_last() for c in order]
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*by))
    return items.withColumn("nth_", nth).where(F.col("nth_") <= most).drop("nth_")


def news_signals(items: DataFrame) -> DataFrame:
    """Signals of news items (``item, title, description, published_ms, risk, confidence, source_count, evidence_weight``).

    Severity is nine times the risk (a missing or zero risk counts as one) with 8 for high and 4 for medium confidence,
    from 10 to 100.  A digest of several stories has no place.
    """
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    bonus = F.when(F.col("confidence") == "high", 8).when(F.col("confidence") == "medium", 4).otherwise(0)
    severity = F.least(F.lit(100), F.greatest(F.lit(10), F.coalesce(F.nullif("risk", F.lit(0)), F.lit(1)) * 9 + bonus))
    found = items.withColumns({"digest": text.is_digest(F.col("title"), F.col("description")), "at_": text.locate(said), "category": text.classify_event(said)})
    at = lambda name: F.when(~F.col("digest"), F.col("at_")[name])
    return found.select(
        F.concat(F.lit("news:"), F.col("item").cast("string")).alias("id"), "title", "category", F.col("published_ms").alias("occurred_ms"), severity.cast("int").alias("severity"),
        at("label").alias("location"), at("lat").alias("lat"), at("lng").alias("lng"), F.coalesce(at("confidence"), F.lit(0.0)).alias("location_confidence"), "digest",
        F.col("source_count").alias("source_count_hint"), F.col("evidence_weight").alias("evidence_weight_hint"),
    )


def news_evidence(
    items: DataFrame, members: DataFrame, osint: Iterable[str] = OSINT_SOURCES, broadcasters: Iterable[str] = BROADCASTERS, dependent: Iterable[str] = NOT_INDEPENDENT,
) -> DataFrame:
    """One row for each item and source (``members``: ``item, source``) with the item's average weight, at least 0.4.

    ``items`` has ``item, primary_source, link, published_ms, source_count, evidence_weight``; only the primary source has the
    item's link.  An item without members has its primary source.
    """
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 80)
    share = F.col("evidence_weight") / F.greatest(F.lit(1), F.coalesce("source_count", F.lit(1)))
    listed = members.select("item", "source").distinct()
    rows = items.join(listed, "item", "left").withColumn("source", F.coalesce("source", "primary_source"))
    kind = F.when(F.col("source").isin(*osint), "osint").when(F.col("source").isin(*broadcasters), "broadcaster").otherwise("editorial")
    return rows.select(
        F.concat(F.lit("news:"), F.col("item").cast("string")).alias("id"), F.concat(F.lit("news:"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("source"))).alias("source_id"), "source",
        kind.alias("kind"), (~F.col("source").isin(*dependent)).alias("independent"), F.greatest(F.lit(0.4), share).alias("weight"),
        F.when(F.col("source") == F.col("primary_source"), F.nullif("link", F.lit(""))).alias("url"), "published_ms",
    )


def dated_vulnerabilities(found: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Vulnerabilities published in the last ``days`` (119 at most), once an id, as the first search term found them.

    ``found`` has ``cve, term, rank`` (of the term), ``place`` (within the term's answer), ``published_ms, v31, v30, v2``; the
    score is that of the newest standard, null if none.  Rows without an id or a date are left out.
    """
    at = F.col("published_ms")
    rows = found.where(at.between(now_ms - min(days, MOST_DAYS) * DAY_MS, now_ms) & (F.coalesce("cve", F.lit("")) != ""))
    first = rows.groupBy("cve").agg(F.min(F.struct("rank", "place", "term", "published_ms", F.coalesce("v31", "v30", "v2").alias("score"))).alias("f"))
    return first.select("cve", "f.term", "f.published_ms", "f.score")


def designated_wallets(entries: DataFrame, asset: Column, now_ms: int, days: int) -> DataFrame:
    """Entries whose name has the shape of an address (``asset`` not null) and that aren't known to be older than ``days``."""
    seen = F.col("first_seen_ms")
    return entries.withColumn("asset", asset).where(F.col("asset").isNotNull() & (seen.isNull() | (seen >= now_ms - days * DAY_MS)))


def spread(rows: DataFrame, by: str, kind: str, order: list[Column]) -> DataFrame:
    """Each group's kinds with their counts, in the order in which they first come: ``by, total, kinds`` as ``3 A, 1 B``.

    Rows are counted before they meet, so a group is as many rows as it has kinds.
    """
    counts = rows.groupBy(by, kind).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", F.col(kind).alias("kind"), "n")))
    said = F.transform(listed, lambda x: F.concat_ws(" ", x["n"].cast("string"), x["kind"]))
    return counts.groupBy(by).agg(F.sum("n").alias("total"), F.array_join(said, ", ").alias("kinds"))


def alert_digest(alerts: DataFrame, by: str) -> DataFrame:
    """The digest of each group's alerts (``kind, ord, magnitude, risk, title, type, high``).

    Kinds are quake, news, weather and conflict.  Strong quakes have a magnitude of five or more and hot news a risk of eight
    or more; the top item is the first of the highest risk, cut to 48 characters; types are the first three of the weather,
    in order.  The level is elevated with a strong quake below ten, hot news, high weather or a top title that says so.
    """
    kind, risk, magnitude = F.col("kind"), F.coalesce("risk", F.lit(0)), F.col("magnitude")
    of = {name: F.coalesce(kind == name, F.lit(False)) for name in ("quake", "news", "weather", "conflict")}
    sums = alerts.groupBy(by).agg(
        F.count_if(of["quake"]).alias("quakes"), F.max(F.when(of["quake"], magnitude)).alias("strongest"), F.count_if(of["quake"] & (magnitude >= 5)).alias("strong"),
        F.count_if(of["news"]).alias("news"), F.count_if(of["news"] & (risk >= 8)).alias("hot"),
        F.max_by(F.substring("title", 1, 48), F.when(of["news"], F.struct(risk.alias("r"), (-F.col("ord")).alias("o")))).alias("top"),
        F.count_if(of["weather"]).alias("weather"), F.count_if(of["weather"] & F.coalesce("high", F.lit(False))).alias("high"), F.count_if(of["conflict"]).alias("conflicts"),
    )
    types = alerts.where(of["weather"] & (F.coalesce("type", F.lit("")) != "")).groupBy(by, "type").agg(F.min("ord").alias("first"))
    three = per_source(types, by, ["first", "type"], 3).groupBy(F.col(by).alias("by_")).agg(F.array_sort(F.collect_list(F.struct("first", "type"))).alias("t"))
    urgent = (F.col("hot") > 0) | (F.col("high") > 0) | F.coalesce((F.col("strongest") >= 5) & (F.col("strongest") < 9.95), F.lit(False))
    urgent = urgent | F.coalesce(F.col("top").rlike("STORM|hot|severe|M[5-9]"), F.lit(False))
    joined = sums.join(three, sums[by].eqNullSafe(three["by_"]), "left").drop("by_")
    return joined.withColumn("types", F.coalesce(F.array_join("t.type", ", "), F.lit(""))).withColumn("level", F.when(urgent, "ELEVATED").otherwise("NOMINAL")).drop("t")


def historical_pairs(reports: DataFrame, epoch: str) -> DataFrame:
    """The pairs that past reviews found, once each, with ``fault``: why a row can't be used, null if it can.

    Reports have ``epoch, sampled_at, distance_km, time_difference_seconds`` and the five named fields.  A fault is another epoch,
    an unreadable time, an empty field, an unknown reason, or a distance or time that is missing, negative or no number.
    """
    empty = F.lit(False)
    for name in PAIR_FIELDS:
        empty = empty | (F.coalesce(name, F.lit("")) == "")
    bad = lambda c: F.coalesce(F.isnan(c.cast("double")) | (c.cast("double") < 0) | (c.cast("double") == float("inf")), F.lit(True))
    at = F.try_to_timestamp("sampled_at")
    fault = (
        F.when(F.coalesce(F.col("epoch") != epoch, F.lit(True)), "epoch").when(at.isNull(), "time").when(empty, "field").when(~F.col("reason").isin(*PAIR_REASONS), "reason")
        .when(bad(F.col("distance_km")), "distance").when(bad(F.col("time_difference_seconds")), "seconds")
    )
    return reports.select(at.alias("sampled"), *PAIR_FIELDS, "distance_km", "time_difference_seconds", fault.alias("fault")).distinct()


def hold_groups(plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """Planned groups (``event_id, action, proposed, blockers``) after past pairs without fault: both sides need a manual review.

    A held group loses its proposal and gains a blocker; ``reviews`` counts its pairs.  A pair of an event with itself holds it once.
    """
    fine = pairs.where("fault IS NULL").select(F.explode(F.array_distinct(F.array("left_event", "right_event"))).alias("event_id"))
    held = fine.groupBy("event_id").agg(F.count("*").alias("reviews"))
    rows = plan.join(held, "event_id", "left")
    on, blocker = F.col("reviews").isNotNull(), F.array(F.lit("historical_pair_requires_review"))
    blockers = F.coalesce("blockers", F.array().cast("array<string>"))
    return rows.select(
        "event_id", F.when(on, "manual_review").otherwise(F.col("action")).alias("action"), F.when(~on, F.col("proposed")).alias("proposed"),
        F.when(on, F.array_sort(F.array_union(blockers, blocker))).otherwise(blockers).alias("blockers"), F.coalesce("reviews", F.lit(0)).alias("reviews"),
    )


def reviewed_components(links: DataFrame) -> DataFrame:
    """Components of stored events and the groups their news identities are in now, with what to review.

    ``links`` has ``stored, revision, identity, news`` and ``current`` (null: the identity isn't observed in a group), one row for
    each group of an identity.  A stored event is incomplete if it also has identities that aren't news, if one of its news
    identities is in none or several groups, or if its links are of several revisions; one incomplete event makes its
    component incomplete.  Stored events without news identities are left out.
    """
    news = F.coalesce("news", F.lit(False))
    per = links.groupBy("stored", "identity").agg(
        F.max(news).alias("news"), F.count_distinct(F.when(news, F.col("current"))).alias("groups"), F.min(F.when(news, F.col("revision"))).alias("low"), F.max(F.when(news, F.col("revision"))).alias("high"),
    )
    stored = per.groupBy("stored").agg(F.max("news").alias("any"), F.max(~F.col("news") | (F.col("groups") != 1)).alias("odd"), F.min("low").alias("low"), F.max("high").alias("high")).where("any")
    name = lambda c, letter: F.concat(F.lit(letter), F.col(c).cast("string"))
    reviews = stored.select(name("stored", "s:").alias("node"), (F.col("odd") | F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("incomplete"))
    edges = links.where(news & F.col("current").isNotNull()).select(name("stored", "s:").alias("src"), name("current", "c:").alias("dst")).distinct()
    parts = connected_components(edges)
    known = parts.join(reviews, "node", "left").select("component", "node", F.coalesce("incomplete", F.lit(False)).alias("incomplete"))
    alone = reviews.join(parts, "node", "left_anti").select(F.col("node").alias("component"), "node", "incomplete")
    is_stored = F.col("node").startswith("s:")
    n = known.unionByName(alone).groupBy("component").agg(F.count_if(is_stored).alias("stored"), F.count_if(~is_stored).alias("current"), F.max("incomplete").alias("incomplete"))
    several = lambda c: F.col(c) > 1
    action = (
        F.when(F.col("incomplete"), "review_missing_or_ambiguous_observations").when(several("stored") & several("current"), "review_overlap")
        .when(several("stored"), "review_merge").when(several("current"), "review_split").otherwise("review_consistent")
    )
    return n.withColumn("action", action)


def at_centroids(rows: DataFrame, code: Column, centroids: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Rows whose country code has a centroid (``code, lat, lng``), placed there; with ``ordinal``, moved by up to two degrees by it."""
    placed = rows.withColumn("code", F.upper(F.trim(code))).join(centroids, "code")
    if ordinal is None:
        return placed
    shift = lambda step: ((F.col(ordinal) * step) % 200 - 100) / 100 * 2
    return placed.withColumns({"lat": F.col("lat") + shift(251.3), "lng": F.col("lng") + shift(137.5)})


def top_origins(rows: DataFrame, code: Column, weight: str, centroids: DataFrame, most: int) -> DataFrame:
    """The ``most`` country codes of the largest share of all weight, in percent to two places, at their centroids."""
    sums = rows.groupBy(code.alias("origin")).agg(F.sum(weight).alias("w"))
    total = sums.agg(F.sum("w").alias("all"))
    shares = sums.join(F.broadcast(total)).where("all > 0").select("origin", "w", F.round(F.col("w") / F.col("all") * 100, 2).alias("share"))
    top = shares.orderBy(F.col("w").desc(), "origin").limit(most)
    return at_centroids(top, F.col("origin"), centroids).select("code", "lat", "lng", "share")
