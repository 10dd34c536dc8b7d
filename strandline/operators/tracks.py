"""Ordered scans: flight legs, path lengths, snapping, streaks, moving averages, candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.geo import haversine_km


def _own(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def current_leg(trace: DataFrame, key: str, order: str, least_ground: int = 4) -> DataFrame:
    """Rows of the leg that each craft is flying or flew last, from a trace with ``on_ground``.

    The leg ends at the newest airborne sample and begins after the newest earlier run of ``least_ground`` or more
    ground samples. A leg of one sample gives the whole trace, a trace that never flew its last two samples.
    """
    own, whole = _own(key, order), Window.partitionBy(key)
    t = trace.withColumn("nth", F.row_number().over(own))
    t = t.withColumn("change", F.coalesce((F.col("on_ground") != F.lag("on_ground").over(own)).cast("int"), F.lit(1)))
    t = t.withColumn("island", F.sum("change").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("run", F.count("*").over(Window.partitionBy(key, "island"))).withColumn("last", F.max(F.when(~F.col("on_ground"), F.col("nth"))).over(whole))
    stop = F.max(F.when(F.col("on_ground") & (F.col("run") >= least_ground) & (F.col("nth") < F.col("last")), F.col("nth"))).over(whole)
    t = t.withColumn("start", F.coalesce(stop, F.lit(0)) + 1).withColumn("n", F.count("*").over(whole))
    leg = F.when(F.col("last").isNull(), F.col("nth") > F.col("n") - 2).when(F.col("last") - F.col("start") < 1, True).otherwise(F.col("nth").between(F.col("start"), F.col("last")))
    return t.where(leg).drop("nth", "change", "island", "run", "last", "start", "n")


def leg_endpoints(leg: DataFrame, key: str, order: str, ceiling_ft: float = 10_000) -> DataFrame:
    """Where a leg began, if it was seen low, and where its trace ended, if on the ground."""
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    at = leg.groupBy(key).agg(first("alt_ft").alias("first_alt"), first("lat").alias("from_lat"), first("lng").alias("from_lng"), last("on_ground").alias("landed"), last("lat").alias("to_lat"), last("lng").alias("to_lng"), F.count("*").alias("n"))
    low = F.col("first_alt").isNull() | (F.col("first_alt") <= ceiling_ft)
    keep = lambda c, ok: F.when(ok & (F.col("n") >= 2), F.col(c)).alias(c)
    return at.select(key, keep("from_lat", low), keep("from_lng", low), keep("to_lat", F.col("landed")), keep("to_lng", F.col("landed")))


def downsample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows a key, evenly spaced, first and last among them."""
    t = rows.withColumn("i", F.row_number().over(_own(key, order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    step = (F.col("n") - 1) / (most - 1)
    # A row stays if some output place rounds to it.
    k = F.ceil((F.col("i") - 0.5) / step)
    place = F.floor(k * step + 0.5)
    return t.where((F.col("n") <= most) | ((place == F.col("i")) & (k >= 0) & (k < most))).drop("i", "n")


def with_steps(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``step_km`` from the row before and ``along_km`` from the first row."""
    own = _own(key, order)
    step = haversine_km(F.lag("lat").over(own), F.lag("lng").over(own), F.col("lat"), F.col("lng"))
    t = rows.withColumn("step_km", F.coalesce(step, F.lit(0.0)))
    return t.withColumn("along_km", F.sum("step_km").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def antimeridian_runs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``part``, a new one wherever the longitude jumps by over 180; parts of one row go."""
    own = _own(key, order)
    jump = F.coalesce((F.abs(F.col("lng") - F.lag("lng").over(own)) > 180).cast("int"), F.lit(0))
    t = rows.withColumn("jump", jump).withColumn("part", F.sum("jump").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("n", F.count("*").over(Window.partitionBy(key, "part"))).where("n > 1").drop("jump", "n")


def snap_to_route(points: DataFrame, route: DataFrame, key: str) -> DataFrame:
    """Nearest place on a route (``route_id, ord, lat, lng``) of each point (``route_id, lat, lng``): segment, off_m, along_m.

    Planar metres around the point; the first of equally near segments wins.
    """
    own = _own("route_id", "ord")
    legs = route.withColumn("lat2", F.lead("lat").over(own)).withColumn("lng2", F.lead("lng").over(own))
    legs = legs.where("lat2 IS NOT NULL").select("route_id", F.col("ord").alias("segment"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "lat2", "lng2")
    m = legs.withColumn("leg_m", haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) * 1000)
    m = m.withColumn("before_m", F.sum("leg_m").over(_own("route_id", "segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("leg_m"))
    j = points.join(m, "route_id")
    ky, kx = F.lit(111_320.0), F.cos(F.radians("lat")) * 111_320.0
    x = lambda c: (F.col(c) - F.col("lng")) * kx
    y = lambda c: (F.col(c) - F.col("lat")) * ky
    dx, dy = x("lng2") - x("lng1"), y("lat2") - y("lat1")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x("lng1") * dx + y("lat1") * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
    j = j.withColumn("share", share)
    off = F.sqrt(F.pow(x("lng1") + F.col("share") * dx, 2) + F.pow(y("lat1") + F.col("share") * dy, 2))
    j = j.withColumn("off_m", off).withColumn("along_m", F.col("before_m") + F.col("share") * F.col("leg_m"))
    best = j.groupBy(key).agg(F.min_by(F.struct("segment", "off_m", "along_m"), F.struct("off_m", "segment")).alias("b"))
    return best.select(key, "b.segment", "b.off_m", "b.along_m")


def candles(trades: DataFrame, bucket: Column, at: str, price: str, volume: str) -> DataFrame:
    """Open, high, low, close and volume a bucket; ``at`` orders the trades."""
    return trades.where(F.col(price).isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(F.coalesce(volume, F.lit(0.0))).alias("volume")
    )


def change_percent(bars: DataFrame, order: str) -> DataFrame:
    """Change of the close against the bar before; null without one or if it is 0."""
    before = F.lag("close").over(Window.orderBy(order))
    return bars.withColumn("previous", before).withColumn("change_pct", F.when(before != 0, (F.col("close") - before) / before * 100))


def quote_changes(closes: DataFrame, quotes: DataFrame, key: str, order: str) -> DataFrame:
    """Each quote's ``price`` against its previous close, in percent: the last but one ``close``, else ``fallback``.

    Null and NaN closes are passed over; a previous close that is null or 0 gives a null change; a quote without closes
    has its fallback; closes without a quote give nothing; equal orders are told apart by the close.
    """
    known = closes.where(F.col("close").isNotNull() & ~F.isnan("close")).select(key, order, "close")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("close")))
    last = known.withColumn("nth", nth).where("nth <= 2").groupBy(key).agg(F.max(F.when(F.col("nth") == 2, F.col("close"))).alias("before"))
    previous = F.coalesce("before", "fallback")
    change = F.when(previous != 0, (F.col("price") - previous) / previous * 100)
    return quotes.join(last, key, "left").select(key, "price", previous.alias("previous"), change.alias("change_pct"))


def ewma(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.25) -> DataFrame:
    """Exponential moving average of each key's values in order, the first one as seed.

    With the weights (1 - a)^(n - i) it is one grouped sum, so that long histories combine before the shuffle.
    """
    t = rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    weight = F.pow(F.lit(1 - alpha), F.col("back")) * F.when(F.col("back") == F.col("n") - 1, 1.0).otherwise(alpha)
    return t.groupBy(key).agg(F.sum(F.col(value) * weight).alias("ewma"))


def failure_streaks(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the running count of failures since the last success (``ok``) and the cooldown in ms it brings."""
    own = _own(key, order).rowsBetween(Window.unboundedPreceding, 0)
    t = attempts.withColumn("wins", F.sum(F.col("ok").cast("int")).over(own))
    streak = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(key, "wins").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("streak", streak)
    wait = F.least(F.lit(900_000), F.lit(60_000) * F.pow(F.lit(2), F.least(F.lit(4), F.col("streak") - 2)).cast("long"))
    return t.withColumn("cooldown_ms", F.when(F.col("streak") >= 2, wait).otherwise(0)).drop("wins")


def content_streaks(notes: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the running ``empty_streak`` and ``stale_streak`` of notes with ``ok``, ``items`` and ``fresh``.

    A success without items lengthens the empty streak, one with items ends it and a failure leaves it; a note without
    fresh items lengthens the stale streak, one with some ends it.  Null items are none; a null ``fresh`` or ``ok`` notes nothing.
    """
    own = _own(key, order).rowsBetween(Window.unboundedPreceding, 0)
    for name, longer, ends in (
        ("empty_streak", F.col("ok") & (F.coalesce("items", F.lit(0)) <= 0), F.col("ok") & (F.coalesce("items", F.lit(0)) > 0)),
        ("stale_streak", F.col("fresh") <= 0, F.col("fresh") > 0),
    ):
        notes = notes.withColumn("ended", F.count_if(ends).over(own))
        since = Window.partitionBy(key, "ended").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        notes = notes.withColumn(name, F.count_if(longer).over(since)).drop("ended")
    return notes


def health_multiplier(success_rate: Column, empty: Column, stale: Column, failures: Column, cooling: Column) -> Column:
    """Product of the penalties for a source's record, within 0.35 and 1.05."""
    m = F.lit(1.0)
    for hit, by in (
        (success_rate < 0.95, 0.92), (success_rate < 0.8, 0.82), (success_rate < 0.6, 0.72), (empty >= 2, 0.88), (empty >= 4, 0.75), (stale >= 3, 0.9), (stale >= 6, 0.75),
    ):
        m = m * F.when(hit, by).otherwise(1.0)
    m = m * F.when(failures > 0, F.greatest(F.lit(0.55), 1 - failures * 0.12)).otherwise(1.0) * F.when(cooling, 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.35), F.least(F.lit(1.05), m))


def ascent_descent(rows: DataFrame, key: str, order: str, height: str, noise: float = 1.0) -> DataFrame:
    """Sums of the climbs and falls from row to row that exceed the noise."""
    step = F.col(height) - F.lag(height).over(_own(key, order))
    t = rows.withColumn("step", step)
    return t.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("step") > noise, F.col("step"))), F.lit(0.0)).alias("ascent"), F.coalesce(-F.sum(F.when(F.col("step") < -noise, F.col("step"))), F.lit(0.0)).alias("descent"))
