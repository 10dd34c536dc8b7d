"""Raw provider payloads to rows.  Each parser takes a frame with one payload a row in ``column`` and returns signals.

Signals are ``id, title, category, at_ms, lat, lng, location, location_confidence, severity, source_id, kind,
weight, upstream_id, url`` and more where a provider has more.  A row that a provider's rules skip is left out; a
payload that must be whole (a catalogue) is dropped whole, with its verdict in ``catalogue_verdicts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.geo import round_half_up
from strandline.functions.text import classify_event, decode_html
from strandline.session import cut

HOUR, DAY = 3_600_000, 86_400_000
# Base severities by category.
BASE_SEVERITY = {
    "conflict": 72, "protest": 52, "political": 48, "earthquake": 65, "flood": 58, "wildfire": 55, "volcano": 68, "weather": 55, "cyber": 60,
    "infrastructure": 58, "aviation": 70, "maritime": 58, "other": 35,
}
NATURAL_SEVERITY = {"wildfire": 58, "volcano": 68, "flood": 60, "earthquake": 66, "weather": 57, "infrastructure": 58, "other": 42}
URGENT_TITLE = "(?iu)breaking|urgent|major|massive|dead|killed|evacuat|срочно|погиб|эвакуац"
NOT_FAMILIES = (
    "32-bit", "64-bit", "arm", "mips", "mipsel", "x86", "x86-64", "sparc", "ppc", "m68k", "sh4", "arc", "elf", "exe", "dll", "zip", "rar", "7z", "doc",
    "docx", "xls", "xlsx", "pdf", "rtf", "lnk", "js", "vbs", "ps1", "sh", "bat", "jar", "apk", "msi", "iso", "img", "html", "htm", "php", "py", "opendir",
    "censys", "ua-wget", "ua-curl", "shodan", "unknown", "encrypted", "obfuscated", "malware", "payload", "binary", "none", "ascii", "iot", "honeypot",
)


def _pick(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def iso_ms(text: Column) -> Column:
    """Milliseconds of an ISO time (also compact ``YYYYMMDDTHHMMSSZ``); null if it isn't one."""
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$", "$1-$2-$3T$4:$5:$6Z")
    return F.unix_millis(compact.try_cast("timestamp"))


def event_severity(category: Column, title: Column) -> Column:
    return clamp(_pick(category, BASE_SEVERITY, 35) + F.when(title.rlike(URGENT_TITLE), 10).otherwise(0), 0, 100)


def quake_severity(mag: Column, tsunami: Column, alert: Column) -> Column:
    base = F.when(mag >= 7, 96).when(mag >= 6, 88).when(mag >= 5, 76).when(mag >= 4, 62).when(mag >= 3, 48).otherwise(36) + F.when(tsunami, 8).otherwise(0)
    return clamp(F.when(alert == "red", F.greatest(base, F.lit(95))).when(alert == "orange", F.greatest(base, F.lit(82))).otherwise(base), 0, 100)


QUAKES = "features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<mag:double,place:string,time:bigint,updated:bigint,url:string,tsunami:int,alert:string>>>"


def earthquakes(payloads: DataFrame, column: str) -> DataFrame:
    """GeoJSON earthquakes; without id, two coordinates or a magnitude a feature is skipped."""
    f = payloads.select(F.explode(F.from_json(column, QUAKES)["features"]).alias("f")).select("f.id", "f.geometry.coordinates", "f.properties.*")
    ok = f.where((F.col("id") != "") & (F.size("coordinates") >= 2) & F.col("mag").isNotNull() & F.col("coordinates")[0].isNotNull() & F.col("coordinates")[1].isNotNull())
    place = F.coalesce(F.nullif(F.trim("place"), F.lit("")), F.lit("Unknown location"))
    return ok.select(
        F.concat(F.lit("usgs:"), "id").alias("id"), F.format_string("M%.1f earthquake — %s", "mag", place).alias("title"), F.lit("earthquake").alias("category"), F.col("time").alias("at_ms"),
        F.col("coordinates")[1].alias("lat"), F.col("coordinates")[0].alias("lng"), place.alias("location"), F.lit(1.0).alias("location_confidence"),
        quake_severity(F.col("mag"), F.coalesce(F.col("tsunami") > 0, F.lit(False)), F.col("alert")).alias("severity"), F.lit("usgs-earthquakes").alias("source_id"), F.lit("sensor").alias("kind"), F.lit(1.5).alias("weight"), "url",
    )


def _tag(item: Column, tag: str) -> Column:
    raw = F.regexp_extract(item, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(decode_html(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))


def disaster_feed(payloads: DataFrame, column: str) -> DataFrame:
    """Disaster RSS items with a title and coordinates within range."""
    i = payloads.select(F.explode(F.slice(F.split(column, "(?i)<item>"), 2, 1_000_000)).alias("item")).select(F.regexp_replace("item", "(?is)</item>.*$", "").alias("item"))
    names = {"title": "title", "lat": "geo:lat", "lng": "geo:long", "kind_code": "gdacs:eventtype", "event_id": "gdacs:eventid", "alert": "gdacs:alertlevel", "from_date": "gdacs:fromdate", "location": "gdacs:country", "url": "link"}
    t = i.select(*[_tag(F.col("item"), tag).alias(n) for n, tag in names.items()]).withColumn("lat", F.col("lat").try_cast("double")).withColumn("lng", F.col("lng").try_cast("double"))
    t = t.where(F.col("title").isNotNull() & F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    code = F.coalesce("kind_code", F.lit("UNK"))
    t = t.withColumn("category", _pick(code, {"EQ": "earthquake", "TC": "weather", "FL": "flood", "VO": "volcano", "WF": "wildfire"}, "other"))
    severity = F.when(F.col("alert").rlike("(?i)red"), 92).when(F.col("alert").rlike("(?i)orange"), 75).when(F.col("alert").rlike("(?i)green"), 50).otherwise(event_severity(F.col("category"), F.lit("")))
    own = F.coalesce("event_id", F.concat_ws("-", F.col("lat").cast("string"), F.col("lng").cast("string"), "title"))
    return t.select(
        F.concat_ws(":", F.lit("gdacs"), code, own).alias("id"), "title", "category", iso_ms(F.col("from_date")).alias("at_ms"), "lat", "lng", "location", F.lit(1.0).alias("location_confidence"),
        severity.alias("severity"), F.lit("gdacs").alias("source_id"), F.lit("official").alias("kind"), F.lit(1.3).alias("weight"), "url",
    )


ARTICLES = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>"


def article_search(payloads: DataFrame, column: str) -> DataFrame:
    """Articles with a URL and a title of eight characters; the first of each URL in payload order."""
    a = payloads.select(F.posexplode(F.from_json(column, ARTICLES)["articles"]).alias("ord", "a")).select("ord", "a.*")
    a = a.where((F.length(F.trim("title")) >= 8) & (F.col("url") != ""))
    first = F.row_number().over(Window.partitionBy("url").orderBy("ord"))
    a = a.withColumn("n", first).where("n = 1").withColumn("category", classify_event(F.col("title")))
    return a.select(
        F.concat(F.lit("gdelt:"), "url").alias("id"), "title", "category", iso_ms(F.col("seendate")).alias("at_ms"), event_severity(F.col("category"), F.col("title")).cast("int").alias("severity"),
        F.lit("gdelt").alias("source_id"), F.lit("media").alias("kind"), F.lit(0.65).alias("weight"), "url",
    )


NATURAL = (
    "events array<struct<id:string,title:string,description:string,link:string,categories:array<struct<id:string,title:string>>,sources:array<struct<id:string,url:string>>,"
    "geometry:array<struct<date:string,type:string,coordinates:string,magnitudeValue:double>>>>"
)


def natural_events(payloads: DataFrame, column: str, now_ms: int) -> DataFrame:
    """Open natural events by their last geometry, at most seven days old and one hour ahead; its centre as place."""
    e = payloads.select(F.explode(F.from_json(column, NATURAL)["events"]).alias("e")).select("e.*").where((F.col("id") != "") & (F.col("title") != "") & (F.size("geometry") > 0))
    last = F.element_at("geometry", -1)
    numbers = F.transform(F.regexp_extract_all(last["coordinates"], F.lit(r"(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)"), 1), lambda x: x.cast("double"))
    e = e.withColumns({"at_ms": iso_ms(last["date"]), "xy": numbers, "updates": F.size("geometry"), "magnitude": last["magnitudeValue"]})
    names = F.lower(F.array_join(F.transform("categories", lambda c: F.concat_ws(" ", c["id"], c["title"])), " "))
    rules = (("wildfire", "fire"), ("volcano", "volcano"), ("flood", "flood"), ("earthquake", "quake"), ("weather", "storm|cyclone|snow|ice|drought|temp"))
    category = F.coalesce(*[F.when(names.rlike(p), c) for c, p in rules], F.lit("other"))
    pairs = (F.size("xy") / 2).cast("int")
    side = lambda odd: F.aggregate(F.filter("xy", lambda _, i: i % 2 == odd), F.lit(0.0), lambda a, x: a + x) / pairs
    e = e.withColumn("category", category).where(F.col("at_ms").between(now_ms - 7 * DAY, now_ms + HOUR) & (F.size("xy") >= 2))
    raw = _pick(F.col("category"), NATURAL_SEVERITY, 42) + F.coalesce(F.least(F.lit(14.0), F.greatest(F.lit(0.0), "magnitude") * 1.5), F.lit(0.0)) + F.least(F.lit(12.0), F.log2("updates") * 3)
    return e.select(
        F.concat(F.lit("eonet:"), "id").alias("id"), "title", "category", "at_ms", side(1).alias("lat"), side(0).alias("lng"), F.when(pairs == 1, 0.98).otherwise(0.78).alias("location_confidence"),
        clamp(round_half_up(raw), 0, 100).cast("int").alias("severity"), F.lit("nasa-eonet").alias("source_id"), F.lit("official").alias("kind"), F.lit(1.2).alias("weight"),
        F.concat(F.lit("eonet:"), "id").alias("upstream_id"), F.coalesce(F.filter("sources", lambda s: s["url"] != "")[0]["url"], "link").alias("url"),
    )


OUTAGES = "annotations array<struct<id:string,locations:array<string>,locationsDetails:array<struct<code:string,name:string>>,scope:string,eventType:string,outage:struct<outageCause:string,outageType:string>,description:string,startDate:string,endDate:string,linkedUrl:string>>"


def outages(payloads: DataFrame, column: str, centroids: DataFrame, now_ms: int) -> DataFrame:
    """Internet outages, a row for each country with a centroid (``code, lat, lng``, one row a country)."""
    a = payloads.select(F.explode(F.from_json(column, OUTAGES)["annotations"]).alias("a")).select("a.*").withColumn("ended", F.coalesce(F.col("endDate") != "", F.lit(False)))
    a = a.where(~F.col("ended") | iso_ms(F.col("endDate")).between(now_ms - 7 * DAY, now_ms + HOUR)).withColumn("code", F.explode(F.transform("locations", F.upper)))
    cause = F.coalesce("outage.outageCause", "outage.outageType", F.lit(""))
    named = F.filter("locationsDetails", lambda d: F.upper(d["code"]) == F.col("code"))[0]["name"]
    own = F.concat_ws(":", F.lit("cloudflare-outage"), F.coalesce("id", "startDate"), "code")
    return a.join(F.broadcast(centroids), "code").select(  # some 250 countries
        own.alias("id"), F.concat(F.when(F.col("ended"), "Internet disruption").otherwise("Ongoing internet disruption"), F.lit(" — "), F.coalesce(named, "code")).alias("title"),
        F.lit("infrastructure").alias("category"), iso_ms(F.col("startDate")).alias("at_ms"), "lat", "lng", F.coalesce(named, "code").alias("location"), F.lit(0.45).alias("location_confidence"),
        clamp(F.when(F.col("ended"), 48).otherwise(65) + F.when(cause.rlike("(?i)government|power|cable|natural"), 8).otherwise(0), 0, 90).alias("severity"),
        F.lit("cloudflare-radar-outages").alias("source_id"), F.lit("sensor").alias("kind"), F.lit(1.25).alias("weight"), own.alias("upstream_id"), F.col("linkedUrl").alias("url"),
    )


WARNINGS = (
    "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<id:string,`@id`:string,headline:string,event:string,severity:string,sent:string,expires:string,areaDesc:string,"
    "description:string,instruction:string,status:string,messageType:string,`references`:array<struct<identifier:string,`@id`:string,sent:string>>>>>"
)
ALERTS = "https://api.weather.gov/alerts/"


def representative_point(kind: Column, coordinates: Column) -> Column:
    """``struct<lng, lat>``: the point, or the mean of the (first) outer ring; null if any vertex is out of range."""
    ring = F.when(kind == "Point", F.concat(F.lit("["), coordinates, F.lit("]"))).when(kind == "Polygon", F.from_json(coordinates, "array<string>")[0]).when(kind == "MultiPolygon", F.from_json(F.from_json(coordinates, "array<string>")[0], "array<string>")[0])
    xy = F.from_json(ring, "array<array<double>>")
    fine = (F.size(xy) > 0) & F.forall(xy, lambda p: F.coalesce((F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90), F.lit(False)))
    mean = lambda k: F.aggregate(xy, F.lit(0.0), lambda a, p: a + p[k]) / F.size(xy)
    return F.when(fine, F.struct(mean(0).alias("lng"), mean(1).alias("lat")))


def weather_warnings(payloads: DataFrame, column: str, now_ms: int, page: str | None = None) -> DataFrame:
    """Actual warnings; the last row of each id wins; cancelled or expired ones stay withdrawn while they retire others.

    A payload that comes in several rows is ordered by its ``page``.
    """
    p = payloads.select(F.lit(0).alias("page") if page is None else F.col(page).alias("page"), F.posexplode(F.from_json(column, WARNINGS)["features"]).alias("nth", "f"))
    p = p.select(F.struct("page", "nth").alias("ord"), "f.geometry", "f.properties.*")
    p = p.withColumns({"key": F.coalesce(F.nullif("id", F.lit("")), "@id"), "sent_ms": iso_ms(F.col("sent")), "expires_ms": iso_ms(F.col("expires")), "kind_": F.coalesce("messageType", F.lit("Alert"))})
    p = p.where((F.col("status") == "Actual") & F.col("kind_").isin("Alert", "Update", "Cancel") & F.col("key").isNotNull() & (F.col("event") != "") & (F.col("sent_ms") <= now_ms + 60_000))
    usable = F.filter(F.coalesce("references", F.array()), lambda r: F.coalesce(r["identifier"], r["@id"]).isNotNull() & ~F.coalesce(iso_ms(r["sent"]) > F.col("sent_ms"), F.lit(False)))
    link = lambda v: F.when(v.startswith(ALERTS), v).otherwise(F.concat(F.lit(ALERTS), F.url_encode(v)))
    p = p.withColumn("supersedes", F.transform(usable, lambda r: link(F.coalesce(F.nullif(r["identifier"], F.lit("")), r["@id"]))))
    p = p.withColumn("withdrawn", (F.col("kind_") == "Cancel") | F.coalesce(F.col("expires_ms") <= now_ms, F.lit(True)))
    p = p.where(~F.col("withdrawn") | ((F.size("supersedes") > 0) & (F.col("sent_ms") >= now_ms - 48 * HOUR)))
    p = p.groupBy("key").agg(F.max_by(F.struct(*[c for c in p.columns if c != "key"]), "ord").alias("p")).select("key", "p.*").withColumn("at", representative_point(F.col("geometry.type"), F.col("geometry.coordinates")))
    return p.select(
        F.concat(F.lit("nws:"), "key").alias("id"), F.coalesce(F.nullif("headline", F.lit("")), "event").alias("title"), F.when(F.col("event").rlike("(?i)flood"), "flood").otherwise("weather").alias("category"),
        F.col("sent_ms").alias("at_ms"), F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"), F.col("areaDesc").alias("location"),
        F.when(F.col("at").isNull(), 0.0).when(F.col("geometry.type") == "Point", 1.0).otherwise(0.6).alias("location_confidence"),
        _pick(F.col("severity"), {"Extreme": 90, "Severe": 75, "Moderate": 50, "Minor": 25}, 20).alias("severity"), F.lit("noaa-nws").alias("source_id"), F.lit("official").alias("kind"), F.lit(1.2).alias("weight"),
        F.when(F.col("@id").startswith(ALERTS), F.col("@id")).otherwise(F.concat(F.lit(ALERTS), F.url_encode("key"))).alias("url"), "supersedes", "withdrawn",
    )


KEV = (
    "catalogVersion string, dateReleased string, count int, vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,"
    "requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string>>"
)


def catalogue_verdicts(payloads: DataFrame, column: str) -> DataFrame:
    """Adds the parsed catalogue ``k`` and ``valid``: all of it must hold, or none of it counts."""
    day = lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$") & d.try_cast("date").isNotNull()
    texts = ("vendorProject", "product", "vulnerabilityName", "shortDescription", "requiredAction")
    row = lambda v: F.coalesce(v["cveID"].rlike(r"^CVE-\d{4}-\d{4,19}$") & day(v["dateAdded"]) & day(v["dueDate"]) & reduce(lambda a, b: a & b, [v[t].isNotNull() for t in texts]), F.lit(False))
    v = F.col("k.vulnerabilities")
    ids = F.transform(v, lambda x: x["cveID"])
    valid = F.col("k.catalogVersion").isNotNull() & iso_ms(F.col("k.dateReleased")).isNotNull() & (F.col("k.count") == F.size(v)) & F.forall(v, row) & (F.size(F.array_distinct(ids)) == F.size(v))
    return payloads.withColumn("k", F.from_json(column, KEV)).withColumn("valid", F.coalesce(valid, F.lit(False)))


def known_exploits(payloads: DataFrame, column: str, now_ms: int) -> DataFrame:
    """Entries of valid catalogues that were added in the last 30 days, the newest first, then by id."""
    k = catalogue_verdicts(payloads, column).where("valid").select(F.explode("k.vulnerabilities").alias("v")).select("v.*").withColumn("at_ms", F.unix_millis(F.col("dateAdded").cast("timestamp")))
    k = k.where(F.col("at_ms").between(now_ms - 30 * DAY, now_ms)).orderBy(F.desc("dateAdded"), "cveID")
    return k.select(
        F.concat(F.lit("cisa-kev:"), "cveID").alias("id"), F.concat_ws(" · ", F.lit("CISA KEV addition"), "cveID", "vulnerabilityName").alias("title"), F.lit("cyber").alias("category"), "at_ms",
        F.when(F.col("knownRansomwareCampaignUse") == "Known", 80).otherwise(70).alias("severity"), F.lit("cisa-kev").alias("source_id"), F.lit("official").alias("kind"), F.lit(1.2).alias("weight"), F.col("cveID").alias("upstream_id"),
    )


def space_bulletins(payloads: DataFrame, column: str, now_ms: int) -> DataFrame:
    """Space-weather bulletins by code and serial number (or time); the latest correction wins."""
    b = payloads.select(F.explode(F.from_json(column, "array<struct<product_id:string,issue_datetime:string,message:string>>")).alias("b")).select("b.*")
    text = F.trim(F.regexp_replace("message", "\r\n?", "\n"))
    b = b.withColumns({"text": text, "at_ms": iso_ms(F.concat(F.regexp_replace(F.regexp_replace("issue_datetime", " ", "T"), "Z$", ""), F.lit("Z")))})
    b = b.where(F.col("at_ms").between(now_ms - 7 * DAY, now_ms + HOUR))
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    b = b.withColumns({"code": F.coalesce(found(r"(?im)^Space Weather Message Code:\s*(\S+)"), "product_id"), "serial": found(r"(?im)^Serial Number:\s*(\d+)")})
    head = F.coalesce(found(r"(?im)^\s*((?:(?:CONTINUED|EXTENDED|CANCEL)\s+)?(?:ALERT|WARNING|WATCH|SUMMARY)\s*:.*?)\s*$"), F.concat("code", F.lit(" bulletin")))
    scale = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)NOAA Scale:\s*[GRS]([1-5])\b"), 1), lambda x: x.cast("int")))
    b = b.withColumns({"head": head, "scale": scale, "upstream_id": F.concat_ws("/", "code", F.coalesce("serial", F.col("at_ms").cast("string")))})
    severity = F.when(F.col("head").rlike(r"(?i)^CANCEL\s"), 15).otherwise(F.coalesce(F.get(F.array(*map(F.lit, (0, 40, 55, 70, 85, 95))), F.col("scale")), F.lit(35)))
    last = b.groupBy("upstream_id").agg(F.max_by(F.struct("head", severity.alias("severity"), "at_ms"), "at_ms").alias("l"))
    return last.select(
        F.concat(F.lit("swpc:"), "upstream_id").alias("id"), F.concat(F.lit("Space weather bulletin · "), "l.head").alias("title"), F.lit("weather").alias("category"), "l.at_ms", "l.severity",
        F.lit("noaa-swpc").alias("source_id"), F.lit("official").alias("kind"), F.lit(1.2).alias("weight"), "upstream_id",
    )


#: Places of the columns that count in the 61-column event export (fixed values).
EXPORT = {"event_id": 0, "event_code": 26, "root_code": 28, "quad": 29, "goldstein": 30, "sources": 32, "articles": 33, "tone": 34, "place": 52, "country": 53, "lat": 56, "lng": 57, "added": 59, "url": 60}


def coded_events(lines: DataFrame, column: str, order: str, min_articles: int = 0, quads: tuple[int, ...] = (), limit: int | None = None) -> DataFrame:
    """Tab-separated event export: placed rows with enough articles, the first ``limit`` in file order."""
    c = lines.select(order, F.split(column, "\t").alias("c")).where(F.size("c") >= 61).select(order, *[F.col("c")[i].alias(n) for n, i in EXPORT.items()])
    for n in ("lat", "lng", "goldstein", "tone"):
        c = c.withColumn(n, F.col(n).try_cast("double"))
    for n in ("quad", "sources", "articles"):
        c = c.withColumn(n, F.coalesce(F.col(n).try_cast("int"), F.lit(0)))
    c = c.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~((F.col("lat") == 0) & (F.col("lng") == 0)) & (F.col("articles") >= min_articles))
    if quads:
        c = c.where(F.col("quad").isin(*quads))
    return c.orderBy(order).limit(limit) if limit else c


def earlier_window(name: Column, steps: int, minutes: int = 15) -> Column:
    """A ``YYYYMMDDHHMMSS`` name so many windows back."""
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(name, "yyyyMMddHHmmss") - steps * minutes * 60), "yyyyMMddHHmmss")


def malware_family(tags: Column, threat: Column) -> Column:
    """The first tag that names a family and no file format, scanner, address or hash; else the threat."""
    named = F.filter(F.transform(tags, F.trim), lambda t: (t != "") & ~F.lower(t).isin(*NOT_FAMILIES) & ~t.rlike(r"^\d+$|^\d{1,3}(?:-\d{1,5}){3,4}$|^(?i:[0-9a-f]{6,})$"))
    return F.coalesce(F.get(named, F.lit(0)), F.nullif(F.regexp_replace(threat, "_", " "), F.lit("")), F.lit("malware"))


URLHAUS = "id bigint, dateadded string, url string, status string, last_online string, threat string, tags string, link string, reporter string"


def malicious_urls(lines: DataFrame, column: str) -> DataFrame:
    """Quoted CSV lines; comments, short rows and rows without a numeric id are skipped; tags as an array."""
    rows = lines.where(~F.col(column).startswith("#") & F.col(column).rlike('^"\\d+",')).select(F.from_csv(column, F.lit(URLHAUS), {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return rows.where("id IS NOT NULL AND reporter IS NOT NULL").withColumn("tags", F.filter(F.split("tags", ","), lambda t: F.trim(t) != ""))


def host_groups(records: DataFrame) -> DataFrame:
    """Malicious URLs by IPv4 host: count, newest and oldest by id, family."""
    from strandline.functions.net import IPV4, host_port

    h = records.withColumn("hp", host_port(F.col("url"))).where(F.col("hp.host").rlike(IPV4))
    g = h.groupBy(F.col("hp.host").alias("ip")).agg(F.count("*").alias("urls"), F.max_by(F.struct("id", "hp.port", "tags", "threat", "dateadded"), "id").alias("new"), F.min_by("dateadded", "id").alias("first_seen"))
    return g.select("ip", "new.port", "urls", F.col("new.id").alias("newest_id"), "first_seen", F.col("new.dateadded").alias("last_seen"), malware_family(F.col("new.tags"), F.col("new.threat")).alias("family"))


#: Rows that one range of ``with_neighbours`` has.
RANGE_ROWS = 250_000


def with_neighbours(rows: DataFrame, order: str, column: str) -> DataFrame:
    """Adds ``before`` and ``next``, the column's value in the rows before and after in a unique order, over all rows.

    Rows are range-partitioned and each partition looks at its own; only the edges of neighbouring partitions, a row
    each, are met with each other.  Ranges have about ``RANGE_ROWS`` however many rows there are, and no task orders more
    than the few that meet in it: their number is given, so that none are put together by their packed size.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = cut(rows.repartitionByRange(ranges, order).withColumn("_pid", F.spark_partition_id())).repartition(ranges, "_pid")
    own = Window.partitionBy("_pid").orderBy(order)
    value = F.struct(F.col(column).alias("v"))
    r = ranged.withColumns({"_before": F.lag(value).over(own), "_next": F.lead(value).over(own)})
    edges = ranged.groupBy("_pid").agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    row = Window.orderBy("_pid")  # a row a partition
    edges = edges.select("_pid", F.lag("last").over(row).alias("_earlier"), F.lead("first").over(row).alias("_later"))
    met = r.join(F.broadcast(edges), "_pid")
    return met.withColumns({"before": F.coalesce("_before", "_earlier")["v"], "next": F.coalesce("_next", "_later")["v"]}).drop("_pid", "_before", "_next", "_earlier", "_later")


def orbital_elements(lines: DataFrame, column: str, order: str) -> DataFrame:
    """Two-line elements with an optional name line before: ``norad, name, inclination, mean_motion, line1, line2``."""
    t = with_neighbours(lines.select(order, F.rtrim(column).alias("l")), order, "l")
    t = t.where(F.col("l").rlike("^1 ") & F.col("next").rlike("^2 "))
    norad = F.trim(F.substring("l", 3, 5))
    name = F.when(F.col("before").rlike("^[12] ") | F.col("before").isNull() | (F.trim("before") == ""), F.concat(F.lit("SAT-"), norad)).otherwise(F.trim(F.regexp_replace("before", "^0 ", "")))
    return t.select(norad.alias("norad"), name.alias("name"), F.trim(F.substring("next", 9, 8)).cast("double").alias("inclination"), F.trim(F.substring("next", 53, 11)).cast("double").alias("mean_motion"), F.col("l").alias("line1"), F.col("next").alias("line2"))


def position_states(states: DataFrame, column: str) -> DataFrame:
    """Positional state vectors to rows with feet and knots; without a place they are skipped."""
    s = states.select(F.from_json(column, "array<string>").alias("s"))
    n = lambda i: F.col("s")[i].try_cast("double")
    return s.select(
        F.lower(F.trim(F.col("s")[0])).alias("hex"), F.trim(F.col("s")[1]).alias("callsign"), F.col("s")[2].alias("country"), n(6).alias("lat"), n(5).alias("lng"), round_half_up(n(7) * 3.28084).alias("alt_ft"),
        round_half_up(n(9) * 1.94384).alias("speed_kt"), n(10).alias("track"), F.coalesce(F.col("s")[8] == "true", F.lit(False)).alias("on_ground"),
    ).where("lat IS NOT NULL AND lng IS NOT NULL")


def ship_states(messages: DataFrame, key: str = "mmsi", at: str = "at_ms") -> DataFrame:
    """Position and static messages merged by ship: the newest known value of every field."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c)
    s = messages.groupBy(key).agg(*[last(c) for c in messages.columns if c not in (key, at)], F.max(at).alias(at))
    code = F.col("type_code")
    return s.withColumn("kind", F.when(code.between(80, 89), "tanker").when(code.between(70, 79), "cargo").when(code == 35, "military").otherwise("other"))


def accepted_entities(pushed: DataFrame, source: str) -> DataFrame:
    """Pushed entities with an id and a place in range, the last of each id; ``accepted`` tells the others."""
    ok = (F.trim("id") != "") & F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    rows = pushed.withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn("entity_id", F.concat_ws("-", F.lit("ext"), F.lit(source), F.trim("id")))
    newest = F.row_number().over(Window.partitionBy("accepted", "entity_id").orderBy(F.desc("ord")))
    return rows.withColumn("n", newest).where("n = 1 OR NOT accepted").drop("n")
