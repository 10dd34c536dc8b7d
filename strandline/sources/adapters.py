"""Event-shaped views of the star-schema tables, by integer arithmetic that any engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Every query that needs a clock takes this one.
NOW = "2024-01-31T00:00:00Z"
CATEGORY = {"error": "infrastructure", "click": "wildfire", "view": "weather", "purchase": "earthquake", "signup": "conflict"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def key_lat(key: Column) -> Column:
    return (key * 7919) % 18000 / 1e2 - 90


def key_lng(key: Column) -> Column:
    return (key * 104729) % 36000 / 1e2 - 180


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ord, source, category, occurred_ms, severity, lat, lng, location_confidence, url_key, user_id, event_type, value``."""
    e = table(spark, sf_dir, "events")
    category = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string"), F.lit(":"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").alias("ord"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"), category.alias("category"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("occurred_ms"), (F.floor("value") % 101).cast("int").alias("severity"),
        key_lat(F.col("event_id")).alias("lat"), key_lng(F.col("event_id")).alias("lng"), ((F.col("event_id") % 5) * 25 / 1e2).alias("location_confidence"),
        F.get_json_object("props", "$.k").cast("long").alias("url_key"), "user_id", "event_type", "value",
    )


SIGNALS_SQL = """signals AS (
  SELECT 'src' || (user_id % 7) || ':' || event_id AS id, event_id AS ord, 'src' || (user_id % 7) AS source,
    CASE event_type WHEN 'error' THEN 'infrastructure' WHEN 'click' THEN 'wildfire' WHEN 'view' THEN 'weather' WHEN 'purchase' THEN 'earthquake' WHEN 'signup' THEN 'conflict' END AS category,
    epoch_us(ts) // 1000 AS occurred_ms, CAST(floor(value) % 101 AS INTEGER) AS severity,
    (event_id * 7919) % 18000 / 1e2 - 90 AS lat, (event_id * 104729) % 36000 / 1e2 - 180 AS lng, (event_id % 5) * 25 / 1e2 AS location_confidence,
    CAST(json_extract(props, '$.k') AS BIGINT) AS url_key, user_id, event_type, value FROM events)"""
NOW_MS = 1706659200000


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered points per user: ``craft, ord, at_ms, lat, lng, alt_ft, on_ground``."""
    e = table(spark, sf_dir, "events")
    ground = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("craft"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        key_lat(F.col("event_id")).alias("lat"), key_lng(F.col("event_id")).alias("lng"),
        F.when(~ground, F.floor(F.col("value") * 100)).cast("double").alias("alt_ft"), ground.alias("on_ground"),
    )


TRACKS_SQL = """tracks AS (
  SELECT user_id AS craft, event_id AS ord, epoch_us(ts) // 1000 AS at_ms, (event_id * 7919) % 18000 / 1e2 - 90 AS lat, (event_id * 104729) % 36000 / 1e2 - 180 AS lng,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100) AS DOUBLE) END AS alt_ft, event_type = 'error' AS on_ground FROM events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, title, description, source, published_ms``: the first 160 characters of the first line as title."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 160).alias("title"), F.col("text").alias("description"), "source",
        (F.lit(NOW_MS) - F.col("doc_id") % 1440 * 60_000).alias("published_ms"),
    )


ARTICLES_SQL = f"""articles AS (
  SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 160) AS title, text AS description, source, {NOW_MS} - doc_id % 1440 * 60000 AS published_ms FROM documents)"""


def places(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A dimension with coordinates from its key: ``<all columns>, lat, lng``."""
    t = table(spark, sf_dir, name)
    return t.withColumn("lat", key_lat(F.col(key) * 31 + 7)).withColumn("lng", key_lng(F.col(key) * 17 + 3))


def places_sql(name: str, key: str) -> str:
    return f"(SELECT *, ((({key} * 31 + 7)::BIGINT * 7919) % 18000) / 1e2 - 90 AS lat, ((({key} * 17 + 3)::BIGINT * 104729) % 36000) / 1e2 - 180 AS lng FROM {name})"
