"""Wallets, sanctions, coverage, country risk, market and graph summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.geo import round_half_up


def counterparties(transactions: DataFrame, most: int = 15) -> DataFrame:
    """Per wallet its counterparties by transactions, then value; directions in and out merge to both.

    Transactions have ``wallet, counterparty, direction, value``.
    """
    known = F.when(F.col("direction").isin("in", "out"), F.col("direction"))
    g = transactions.where("counterparty IS NOT NULL").groupBy("wallet", "counterparty").agg(
        F.count("*").alias("txs"), F.sum("value").alias("value"), F.min(known).alias("lo"), F.max(known).alias("hi"), F.bool_or(known.isNull()).alias("odd")
    )
    g = g.withColumn("direction", F.when(F.col("lo").isNotNull() & (F.col("lo") == F.col("hi")) & ~F.col("odd"), F.col("lo")).otherwise("both")).drop("lo", "hi", "odd")
    nth = F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("txs"), F.desc("value"), "counterparty"))
    return g.withColumn("nth", nth).where(F.col("nth") <= most)


def wallet_activity(transactions: DataFrame, now_ms: int) -> DataFrame:
    """Flow in and out, first and last time, age and dormancy in days, failed transactions."""
    inward, outward = F.col("direction") == "in", F.col("direction") == "out"
    t = transactions.groupBy("wallet").agg(
        F.count("*").alias("txs"), F.coalesce(F.sum(F.when(inward, F.col("value"))), F.lit(0.0)).alias("total_in"), F.coalesce(F.sum(F.when(outward, F.col("value"))), F.lit(0.0)).alias("total_out"),
        F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count_if("failed").alias("failed"), F.count_distinct("counterparty").alias("partners"),
    )
    days = lambda c: F.floor((now_ms - F.col(c)) / 86_400_000)
    return t.withColumn("age_days", days("first_ms")).withColumn("dormant_days", days("last_ms")).withColumn("balance", F.col("total_in") - F.col("total_out"))


LEVELS = ("info", "low", "medium", "high", "critical")


def wallet_factors(activity: DataFrame, sanctioned: Column) -> DataFrame:
    """One row for each rule that a wallet meets, or NOMINAL: ``wallet, code, severity, weight``."""
    rule = lambda ok, code, severity, weight: F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight")))
    c = F.col
    rules = F.array_compact(F.array(
        rule(sanctioned, "OFAC_SDN", "critical", 100), rule(c("age_days") < 7, "NEW_ADDRESS", "low", 10), rule((c("dormant_days") > 365) & (c("age_days") > 400), "DORMANT", "info", 5),
        rule(c("txs") > 10000, "HIGH_VOLUME", "info", 5), rule((c("partners") >= 12) & (c("txs") <= 10000), "FAN_PATTERN", "medium", 20), rule(c("failed") >= 5, "FAILED_TXS", "low", 8),
        rule((c("total_in") > 0) & (c("balance") / c("total_in") < 0.01) & (c("txs") > 5), "DRAINED", "medium", 15),
    ))
    nominal = F.array(F.struct(F.lit("NOMINAL").alias("code"), F.lit("info").alias("severity"), F.lit(0).alias("weight")))
    return activity.withColumn("rules", rules).select("wallet", F.explode(F.when(F.size("rules") > 0, F.col("rules")).otherwise(nominal)).alias("f")).select("wallet", "f.*")


def wallet_scores(factors: DataFrame) -> DataFrame:
    """Sum of the weights within 0 and 100; a critical factor is never diluted."""
    s = factors.groupBy("wallet").agg(F.least(F.lit(100), F.greatest(F.lit(0), F.sum("weight"))).alias("sum"), F.bool_or(F.col("severity") == "critical").alias("critical"), F.count("*").alias("factors"))
    score = F.when(F.col("critical"), F.greatest(F.col("sum"), F.lit(95))).otherwise(F.col("sum"))
    level = F.when(F.col("critical"), "critical").when(F.col("sum") >= 70, "high").when(F.col("sum") >= 40, "medium").when(F.col("sum") >= 15, "low").otherwise("info")
    return s.select("wallet", score.alias("score"), level.alias("level"), "factors")


def ranked_search(rows: DataFrame, name: Column, aliases: Column, query: str, limit: int) -> DataFrame:
    """Exact name, then exact alias, name part, alias part; adds ``rank``."""
    q = query.lower()
    exact, within = F.exists(aliases, lambda a: a == q), F.exists(aliases, lambda a: a.contains(q))
    rank = F.when(name == q, 0).when(exact, 1).when(name.contains(q), 2).when(within, 3)
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "ord").limit(limit)


def coverage(rows: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Per region of a watchlist (``region, country``): rows, countries, band, missing and weak countries, gap score.

    Rows have ``region, country``.
    """
    per_country = rows.groupBy("region", "country").agg(F.count("*").alias("n"))
    total = per_country.groupBy("region").agg(F.sum("n").alias("rows"), F.count("*").alias("countries"))
    w = watchlist.join(per_country, ["region", "country"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = w.groupBy("region").agg(F.count("*").alias("watched"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n").between(1, 4)).alias("weak"), F.sum("n").alias("target"))
    t = w.join(total, "region", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "countries": F.coalesce("countries", F.lit(0))})
    density = F.when(F.col("target") == 0, 40).when(F.col("target") < 10, 30).when(F.col("target") < 50, 15).when(F.col("target") < 100, 5).otherwise(0)
    gap = F.least(F.lit(100), round_half_up(density + F.col("missing") / F.col("watched") * 50 + F.col("weak") / F.col("watched") * 10)).cast("int")
    band = F.when(F.col("rows") == 0, "gap").when(F.col("rows") < 10, "sparse").when(F.col("rows") < 100, "covered").otherwise("dense")
    return t.select("region", "rows", "countries", band.alias("band"), "watched", "missing", "weak", F.when(F.col("missing") + F.col("weak") == 0, 0).otherwise(gap).alias("gap_score"))


def coverage_regions(rows: DataFrame, watchlist: DataFrame, providers: list[str], feeds: list[str]) -> DataFrame:
    """Coverage of each region of a watchlist (``region, country, tier``; a null country lists a region alone), by ``region, country, provider, feed`` rows.

    ``region, rows, countries, band``; ``provider_<name>`` and ``feed_<name>`` counts, zero where there is none (others count
    in no such column); ``watched, seen, missing, weak`` (the two as sorted arrays: no row, under five), ``tier``, the
    lowest of those missing or weak; ``gap_score``; and ``place``, where the region stands among those with a gap: by tier,
    score from above, rows and name; null without a gap.

    A null country counts as a row of its region but as no country; rows of a region that the watchlist doesn't name are
    left out.  Rows are counted by their four fields before anything moves; what is ordered is a row a region.
    """
    n = rows.groupBy("region", "country", "provider", "feed").agg(F.count("*").alias("n"))
    count = lambda field, name: F.sum(F.when(F.col(field) == name, F.col("n")).otherwise(0)).alias(f"{field}_{name}")
    per = n.groupBy("region").agg(F.sum("n").alias("rows"), F.count_distinct("country").alias("countries"), *[count("provider", p) for p in providers], *[count("feed", f) for f in feeds])
    w = watchlist.where("country IS NOT NULL").join(n.groupBy("region", "country").agg(F.sum("n").alias("n")), ["region", "country"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lacks = F.col("n") < 5
    w = w.groupBy("region").agg(
        F.count("*").alias("watched"), F.count_if(F.col("n") > 0).alias("seen"), F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("country")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("n").between(1, 4), F.col("country")))).alias("weak"), F.min(F.when(lacks, F.col("tier"))).alias("tier"), F.sum("n").alias("target"))
    none = F.array().cast("array<string>")
    t = watchlist.select("region").distinct().join(w, "region", "left").join(per, "region", "left").fillna(0).withColumns({"missing": F.coalesce("missing", none), "weak": F.coalesce("weak", none)})
    t = t.withColumn("tier", F.when(F.size("missing") + F.size("weak") > 0, F.col("tier")))
    density = F.when(F.col("target") == 0, 40).when(F.col("target") < 10, 30).when(F.col("target") < 50, 15).when(F.col("target") < 100, 5).otherwise(0)
    gap = F.least(F.lit(100), round_half_up(density + F.size("missing") / F.col("watched") * 50 + F.size("weak") / F.col("watched") * 10)).cast("int")
    band = F.when(F.col("rows") == 0, "gap").when(F.col("rows") < 10, "sparse").when(F.col("rows") < 100, "covered").otherwise("dense")
    t = t.withColumns({"gap_score": F.when(F.size("missing") + F.size("weak") == 0, 0).otherwise(gap), "band": band})
    order = Window.partitionBy(F.col("gap_score") > 0).orderBy(F.coalesce("tier", F.lit(99)), F.desc("gap_score"), "rows", "region")
    t = t.withColumn("place", F.when(F.col("gap_score") > 0, F.row_number().over(order)))
    return t.select("region", "rows", "countries", "band", *[f"provider_{p}" for p in providers], *[f"feed_{f}" for f in feeds], "watched", "seen", "missing", "weak", "tier", "gap_score", "place")


def coverage_countries(rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """``country, tier, rows, status, place`` of the countries of a list (``country, tier``): missing, weak (under five) or covered.

    In order of tier, status, rows and name.  A country listed twice stands with its lowest tier.
    """
    n = rows.where("country IS NOT NULL").groupBy("country").agg(F.count("*").alias("rows"))
    t = tiers.groupBy("country").agg(F.min("tier").alias("tier")).join(n, "country", "left").fillna(0, ["rows"])
    rank = F.when(F.col("rows") == 0, 0).when(F.col("rows") < 5, 1).otherwise(2)
    status = F.get(F.array(F.lit("missing"), F.lit("weak"), F.lit("covered")), rank)
    return t.select("country", "tier", "rows", status.alias("status"), F.row_number().over(Window.orderBy("tier", rank, "rows", "country")).alias("place"))


def country_risk(base: DataFrame, quakes: DataFrame) -> DataFrame:
    """Base risk (``code, base``) plus the magnitudes of a country's quakes (``code, mag``), at most 100; level by base."""
    extra = quakes.groupBy("code").agg(F.sum("mag").alias("extra"))
    b = F.col("base")
    level = F.when(b >= 80, "CRITICAL").when(b >= 60, "HIGH").when(b >= 40, "ELEVATED").otherwise("LOW")
    return base.join(extra, "code", "left").select("code", F.least(F.lit(100.0), b + F.coalesce("extra", F.lit(0.0))).alias("risk_score"), level.alias("risk_level"))


def breadth(quotes: DataFrame, group: str) -> DataFrame:
    """Per group: instruments up and down, best and worst, most common kind (``name, pct, kind``)."""
    return quotes.groupBy(group).agg(
        F.count("*").alias("tracked"), F.count_if(F.col("pct") > 0).alias("up"), F.count_if(F.col("pct") < 0).alias("down"), F.max_by("name", F.struct("pct", "name")).alias("best"),
        F.min_by("name", F.struct("pct", "name")).alias("worst"), F.mode("kind", True).alias("common"),
    ).withColumn("mood", F.when(F.col("up") >= F.col("down"), "risk-on").otherwise("risk-off"))


def provider_health(reports: DataFrame, group: str) -> DataFrame:
    """One state a provider from its feeds' states: all errors make an error, any error or partial a partial."""
    s = F.col("state")
    g = reports.groupBy(group).agg(F.count("*").alias("feeds"), F.count_if(s == "error").alias("errors"), F.count_if(s == "partial").alias("partials"), F.sum("rows").alias("rows"))
    state = F.when(F.col("errors") == F.col("feeds"), "error").when(F.col("errors") + F.col("partials") > 0, "partial").when(F.col("rows") == 0, "empty").otherwise("ok")
    return g.withColumn("state", state)


def exchange_open(at: Column, zone: str, opens: float, closes: float) -> Column:
    """Whether a weekday exchange is open at a UTC time, hours as local decimals."""
    local = F.from_utc_timestamp(at, zone)
    hour = F.hour(local) + F.minute(local) / 60
    return ~F.dayofweek(local).isin(1, 7) & (hour >= opens) & (hour < closes)


def flight_class(callsign: Column, category: Column) -> Column:
    """Military, medical, cargo, airline or private by callsign prefix and category; the first that fits."""
    return (
        F.when(callsign.rlike("^(?:RCH|CNV|NAVY|RRR|GAF|IAM|DUKE|FORTE)"), "military").when(callsign.rlike("^(?:LIFE|MEDEVAC|AIRLIFT)"), "medical")
        .when(callsign.rlike("^(?:FDX|UPS|GTI|CLX|BOX|ABX)"), "cargo").when(callsign.rlike("^[A-Z]{3}[0-9]"), "airline").when(category == "light", "private").otherwise("other")
    )


def satellite_mission(name: Column) -> Column:
    n = F.upper(name)
    rules = (("navigation", "GPS|GLONASS|GALILEO|BEIDOU|NAVSTAR"), ("weather", "NOAA|METEOR|GOES|METOP|FENGYUN"), ("communications", "STARLINK|ONEWEB|IRIDIUM|INTELSAT|GLOBALSTAR"),
             ("earth observation", "LANDSAT|SENTINEL|TERRA|AQUA|WORLDVIEW"), ("station", "ISS|TIANGONG|CSS"))
    return F.coalesce(*[F.when(n.rlike(p), m) for m, p in rules], F.lit("other"))


def failure_kind(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.rlike("timeout|timed out|abort"), "timeout").when(m.rlike("429|rate limit"), "rate_limited").when(m.rlike("401|403|forbidden|unauthor"), "denied")
        .when(m.rlike("404|not found"), "missing").when(m.rlike("http 5|50[0-9]"), "upstream").when(m.rlike("json|parse|invalid"), "malformed").otherwise("network")
    )


def certificate_names(certs: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    """Per ``domain``: all certificates, those different by ``cn, serial`` among the first ``most``, their names under the domain.

    ``names`` has a name a line; blanks and a leading ``*.`` go, and names that don't end with the domain.  Names are sorted
    and stand once.  Null names are none; a null domain is a domain without names; nulls in ``cn`` or ``serial`` are values.
    """
    nth = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    first = certs.select("domain", "cn", "serial", "names", *[c for c in order if c not in ("domain", "cn", "serial", "names")])
    first = first.withColumn("nth", nth).where(F.col("nth") <= most)  # each partition keeps its own first ones before they meet
    clean = F.transform(F.split(F.coalesce("names", F.lit("")), "\n"), lambda n: F.regexp_replace(F.trim(n), "^\\*\\.", ""))
    under = F.filter(clean, lambda n: n.endswith(F.col("domain")))
    unique = first.groupBy("domain", "cn", "serial").agg(F.min_by("names", "nth").alias("names"))
    subdomains = F.array_sort(F.array_distinct(F.flatten(F.collect_list(under))))
    found = unique.groupBy("domain").agg(F.count("*").alias("unique_certs"), subdomains.alias("subdomains")).withColumnRenamed("domain", "of")
    total = certs.groupBy("domain").agg(F.count("*").alias("total_certs"))
    same = F.col("domain").eqNullSafe(F.col("of"))
    return total.join(found, same).select("domain", "total_certs", "unique_certs", F.array_join("subdomains", ",").alias("subdomains"))


def daily_totals(exploits: DataFrame, vulnerabilities: DataFrame, critical: float = 9.0) -> DataFrame:
    """``day, exploit_count, exploit_losses, cve_count, critical_cves`` of every day with an exploit (``day, loss``) or a vulnerability (``day, score``).

    A null loss counts as none and a null score is not critical; a null day is a day of its own.  Both sides are summed
    in the tasks first and then once more together, so a busy day is a row a task.
    """
    no = F.lit(0).cast("long")
    sides = exploits.groupBy("day").agg(F.count("*").alias("exploit_count"), F.sum(F.coalesce(F.col("loss").cast("double"), F.lit(0.0))).alias("exploit_losses")).select("day", "exploit_count", "exploit_losses", no.alias("cve_count"), no.alias("critical_cves"))
    other = vulnerabilities.groupBy("day").agg(F.count("*").alias("cve_count"), F.count_if(F.coalesce("score", F.lit(0.0)) >= critical).alias("critical_cves")).select("day", no.alias("exploit_count"), F.lit(0.0).alias("exploit_losses"), "cve_count", "critical_cves")
    return sides.unionByName(other).groupBy("day").agg(*[F.sum(c).alias(c) for c in ("exploit_count", "exploit_losses", "cve_count", "critical_cves")])
