"""Feed filters, rollups, pages and grid aggregates over signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.geo import round_half_up
from strandline.functions.text import canonical_url

NEW_HOURS = 48


def mappable(lat: Column, lng: Column, confidence: Column, least: float = 0.75) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & (confidence >= least), F.lit(False))


#: Fixed values of the feed's states.
LIFECYCLES = ("new", "updated", "ongoing")
CONFIDENCES = ("confirmed", "corroborating", "unconfirmed")


def feed_filter(
    signals: DataFrame, min_severity: float = 0, categories: list[str] | None = None, only_mappable: bool = False, lifecycle: str | None = None, since: float | None = None
) -> DataFrame:
    """Rows of at least a severity (clamped to 0 to 100), by category, by lifecycle, mappable, changed after ``since``.

    An unknown lifecycle filters nothing; ``since`` counts from 0 in whole numbers; a null severity or sequence fails.
    """
    out = signals.where(F.col("severity") >= max(0, min(100, min_severity)))
    if categories:
        out = out.where(F.col("category").isin(categories))
    if lifecycle in LIFECYCLES:
        out = out.where(F.col("lifecycle") == lifecycle)
    if since is not None:
        out = out.where(F.col("change_sequence") > max(0, int(since // 1)))
    return out.where(mappable(F.col("lat"), F.col("lng"), F.col("location_confidence"))) if only_mappable else out


def delta_page(signals: DataFrame, since: float, limit: int = 200, **filters) -> DataFrame:
    """The first rows changed after ``since`` in order of ``change_sequence``; the limit is clamped to 1 to 300."""
    return feed_filter(signals, since=since, **filters).orderBy("change_sequence").limit(max(1, min(300, limit)))


def feed_totals(events: DataFrame) -> DataFrame:
    """One row: all events, mappable ones, those of each confidence and lifecycle, sources and those that are ``healthy``.

    An empty frame gives zeros; null states are in the total alone.
    """
    at = mappable(F.col("lat"), F.col("lng"), F.col("location_confidence"))
    return events.agg(
        F.count("*").alias("total"), F.count_if(at).alias("mappable"),
        *[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES],
        *[F.count_if(F.col("lifecycle") == c).alias(f"{c}_events") for c in LIFECYCLES],
        F.count_distinct("source").alias("source_count"), F.count_distinct(F.when(F.col("healthy"), F.col("source"))).alias("healthy_sources"),
    )


def feed_rollup(signals: DataFrame) -> DataFrame:
    """Per category: rows, mappable rows, severity bands, users and sources."""
    at = mappable(F.col("lat"), F.col("lng"), F.col("location_confidence"))
    return signals.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(at).alias("mappable"), F.count_if(F.col("severity") >= 70).alias("high"),
        F.count_if(F.col("severity").between(35, 69)).alias("medium"), F.count_if(F.col("severity") < 35).alias("low"),
        F.count_distinct("source").alias("sources"),
    )


def current_reports(signals: DataFrame, now_ms: int, key: str = "id", at: str = "occurred_ms") -> DataFrame:
    """Rows of ``key, at, urls, supersedes, nws, nws_only, withdrawn, expires_ms`` that are still in force.

    Withdrawn rows go.  Of rows whose evidence is the weather service's alone (``nws_only``), those go that have expired by
    ``now_ms``, and those of which a URL is superseded by a weather-service row (``nws``) that is not older.  ``key`` names
    a row.  Nulls: a null flag is false, null arrays are empty, a null time is never retired and retires nothing.
    """
    no, plain = F.lit(False), lambda c: canonical_url(F.col(c))
    rows = signals.where(~F.coalesce("withdrawn", no) & ~F.coalesce(F.col("nws_only") & (F.col("expires_ms") <= now_ms), no))
    retired = signals.where("nws").select(F.explode("supersedes").alias("u"), F.col(at).alias("t")).groupBy(plain("u").alias("u")).agg(F.max("t").alias("retired_at"))
    alerts = rows.where("nws_only").select(F.col(key).alias("gone_key"), F.col(at).alias("t"), F.explode("urls").alias("u")).withColumn("u", plain("u"))
    gone = alerts.join(retired, "u").where("retired_at >= t").select("gone_key")
    return rows.join(gone, F.col(key) == F.col("gone_key"), "left_anti")


def hotspot_grid(points: DataFrame, cell: float = 0.75, most: int = 120) -> DataFrame:
    """Grid cells of hotspots (``lat, lng, frp, brightness, at_ms``) that are dense, strong or intense enough."""
    x, y = F.floor((F.col("lng") + 180) / cell).alias("cell_x"), F.floor((F.col("lat") + 90) / cell).alias("cell_y")
    cells = points.groupBy(x, y).agg(
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.sum("frp").alias("frp_sum"), F.max("frp").alias("frp_max"),
        F.max("brightness").alias("brightness_max"), F.max("at_ms").alias("latest_ms"),
    ).where((F.col("n") >= 3) | (F.col("frp_sum") >= 25) | (F.col("frp_max") >= 20))
    raw = 34 + F.least(F.lit(24.0), 6 * F.log2(F.col("n") + 1)) + F.least(F.lit(28.0), 11 * F.log10(F.col("frp_sum") + 1))
    severity = F.least(F.lit(94), F.greatest(F.lit(35), round_half_up(raw))).cast("int")
    return cells.withColumn("severity", severity).orderBy(F.desc("severity"), F.desc("n"), "cell_x", "cell_y").limit(most)


def jamming_grid(positions: DataFrame, cell: float = 2.0, least: int = 3) -> DataFrame:
    """Cells where at least so many airborne positions (``lat, lng, nac_p, on_ground``) have poor accuracy."""
    poor = positions.where((F.col("nac_p") <= 4) & ~F.col("on_ground"))
    cells = poor.groupBy((F.floor(F.col("lat") / cell) * cell).alias("cell_lat"), (F.floor(F.col("lng") / cell) * cell).alias("cell_lng")).agg(
        F.count("*").alias("n"), F.avg("nac_p").alias("mean_nac")
    )
    return cells.where(F.col("n") >= least).withColumn("severity", round_half_up((1 - F.col("mean_nac") / 4) * 100).cast("int"))


def newest_and_oldest(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max_by(label, order).alias("newest"), F.min_by(label, order).alias("oldest"))


def duplicate_cells(rows: DataFrame, provider: str, digits: int = 3) -> DataFrame:
    """Cells of rounded coordinates with several rows of more than one provider; ``suspected`` is the surplus."""
    cell = lambda c: F.floor(F.col(c) * 10**digits + 0.5).alias(f"cell_{c}")
    return rows.groupBy(cell("lat"), cell("lng")).agg(F.count("*").alias("n"), F.count_distinct(provider).alias("providers")).where("n > 1 AND providers > 1").withColumn("suspected", F.col("n") - 1)


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first by the given order."""
    own = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")


def keep_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the given order, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("last"))
    return last.select(*[F.col(c) if c in key else F.col(f"last.{c}").alias(c) for c in rows.columns])


def page_after(rows: DataFrame, cursor: str, after: int, through: int, size: int) -> DataFrame:
    """One page of a change log within (after, through], with ``has_more`` and the next cursor on every row."""
    seen = rows.where((F.col(cursor) > after) & (F.col(cursor) <= through)).orderBy(cursor).limit(size + 1)
    whole = Window.partitionBy()
    return (
        seen.withColumn("nth", F.row_number().over(Window.orderBy(cursor))).withColumn("has_more", F.max("nth").over(whole) > size)
        .where(F.col("nth") <= size).withColumn("next_cursor", F.max(cursor).over(whole)).drop("nth")
    )


def spatial_round_robin(rows: DataFrame, key: str, cell: float = 3.0, most: int = 100) -> DataFrame:
    """A sample spread over the map: the first row of every cell, then the second, up to ``most`` rows."""
    placed = rows.withColumn("cell_x", F.floor((F.col("lng") + 180) / cell)).withColumn("cell_y", F.floor((F.col("lat") + 90) / cell))
    depth = F.row_number().over(Window.partitionBy("cell_x", "cell_y").orderBy(key))
    return placed.withColumn("depth", depth).orderBy("depth", "cell_x", "cell_y").limit(most)


def systematic_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every k-th row by a dense ordinal column, k as small as keeps ``most`` rows."""
    n = rows.count()
    k = max(1, -(-n // most))
    return rows.where(F.col(order) % k == 0)
