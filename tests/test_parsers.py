"""Inline payloads in, normalised rows out."""

import json

from pyspark.sql import functions as F

from strandline.sources import parsers

NOW = 1706659200000  # 2024-01-31T00:00:00Z
DAY = 86_400_000


def one(spark, payload):
    return spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "raw string")


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "ord long, line string")


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_earthquakes(spark):
    p = {"features": [
        {"id": "a1", "geometry": {"coordinates": [10.5, -20.25, 7]}, "properties": {"mag": 6.14, "place": " Sea ", "time": NOW, "url": "u", "tsunami": 1, "alert": "orange"}},
        {"id": "a2", "geometry": {"coordinates": [1, 2]}, "properties": {"mag": 2.0, "place": "", "time": NOW}},
        {"id": "a3", "geometry": {"coordinates": [1]}, "properties": {"mag": 5}}, {"id": "a4", "geometry": {"coordinates": [1, 2]}, "properties": {}},
    ]}
    assert rows(parsers.earthquakes(one(spark, p), "raw"), "id", "title", "lat", "lng", "severity") == [
        ("usgs:a1", "M6.1 earthquake — Sea", -20.25, 10.5, 96), ("usgs:a2", "M2.0 earthquake — Unknown location", 2.0, 1.0, 36),
    ]


def test_disaster_feed(spark):
    item = "<item><title>{t} &amp; more</title><geo:lat>{la}</geo:lat><geo:long>{lo}</geo:long><gdacs:eventtype>FL</gdacs:eventtype><gdacs:eventid>{i}</gdacs:eventid><gdacs:alertlevel>Orange</gdacs:alertlevel><gdacs:fromdate>2024-01-30T01:00:00Z</gdacs:fromdate></item>"
    xml = "<rss>" + item.format(t="Flood", la=4.5, lo=-7, i=9) + item.format(t="Bad", la=95, lo=0, i=1) + "</rss>"
    assert rows(parsers.disaster_feed(one(spark, xml), "raw"), "id", "title", "category", "severity", "at_ms") == [("gdacs:FL:9", "Flood & more", "flood", 75, NOW - DAY + 3_600_000)]


def test_articles(spark):
    p = {"articles": [{"url": "x", "title": "Missile attack reported", "seendate": "20240130T010000Z"}, {"url": "x", "title": "Second copy of it"}, {"url": "y", "title": "short"}]}
    assert rows(parsers.article_search(one(spark, p), "raw"), "id", "category", "severity", "at_ms") == [("gdelt:x", "conflict", 72, NOW - DAY + 3_600_000)]


def test_natural_events(spark):
    g = lambda d, c: {"date": d, "type": "Point", "coordinates": c, "magnitudeValue": 4}
    p = {"events": [
        {"id": "E1", "title": "Fire", "categories": [{"id": "wildfires", "title": "Wildfires"}], "sources": [{"id": "s", "url": "su"}], "geometry": [g("2024-01-01T00:00:00Z", [1, 2]), g("2024-01-30T00:00:00Z", [3, 4])]},
        {"id": "E2", "title": "Old", "categories": [], "geometry": [g("2023-01-30T00:00:00Z", [3, 4])]},
        {"id": "E3", "title": "Area", "categories": [{"id": "floods"}], "link": "l", "geometry": [g("2024-01-30T00:00:00Z", [[[0, 0], [2, 4]]])]},
    ]}
    assert rows(parsers.natural_events(one(spark, p), "raw", NOW), "id", "category", "lat", "lng", "location_confidence", "severity", "url") == [
        ("eonet:E1", "wildfire", 4.0, 3.0, 0.98, 67, "su"), ("eonet:E3", "flood", 2.0, 1.0, 0.78, 66, "l"),
    ]


def test_outages(spark):
    p = {"annotations": [
        {"id": "o1", "locations": ["ye", "zz"], "locationsDetails": [{"code": "YE", "name": "Yemen"}], "outage": {"outageCause": "CABLE_CUT"}, "startDate": "2024-01-30T00:00:00Z"},
        {"id": "o2", "locations": ["YE"], "locationsDetails": [], "startDate": "2023-01-01T00:00:00Z", "endDate": "2023-01-02T00:00:00Z"},
    ]}
    c = spark.createDataFrame([("YE", 15.5, 48.5)], "code string, lat double, lng double")
    assert rows(parsers.outages(one(spark, p), "raw", c, NOW), "id", "title", "severity") == [("cloudflare-outage:o1:YE", "Ongoing internet disruption — Yemen", 73)]


def warning(i, **more):
    p = {"id": i, "event": "Flood Warning", "severity": "Severe", "sent": "2024-01-30T20:00:00Z", "expires": "2024-02-01T00:00:00Z", "status": "Actual", "messageType": "Alert"} | more
    return {"geometry": p.pop("geometry", None), "properties": p}


def test_weather_warnings(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2]]]}
    p = {"features": [
        warning("w1", geometry=square), warning("w1", headline="Newer", geometry=square), warning("w2", status="Test"), warning("w3", messageType="Cancel", references=[{"identifier": "w0", "sent": "2024-01-30T10:00:00Z"}]),
        warning("w4", expires="2024-01-30T21:00:00Z"), warning("w5", severity="x", event="Wind", geometry={"type": "Point", "coordinates": [200, 1]}),
    ]}
    assert rows(parsers.weather_warnings(one(spark, p), "raw", NOW), "id", "title", "category", "lat", "lng", "severity", "withdrawn", F.array_join("supersedes", ",")) == [
        ("nws:w1", "Newer", "flood", 1.0, 2.0, 75, False, ""), ("nws:w3", "Flood Warning", "flood", None, None, 75, True, parsers.ALERTS + "w0"), ("nws:w5", "Wind", "weather", None, None, 20, False, ""),
    ]


def test_known_exploits(spark):
    v = lambda i, d="2024-01-20", **m: {"cveID": i, "vendorProject": "v", "product": "p", "vulnerabilityName": "n", "dateAdded": d, "shortDescription": "s", "requiredAction": "r", "dueDate": "2024-03-01"} | m
    cat = lambda *vs, **m: {"catalogVersion": "1", "dateReleased": "2024-01-30T00:00:00Z", "count": len(vs), "vulnerabilities": list(vs)} | m
    good = cat(v("CVE-2024-0002", knownRansomwareCampaignUse="Known"), v("CVE-2024-0001"), v("CVE-2023-0001", "2023-05-05"))
    assert rows(parsers.known_exploits(one(spark, good), "raw", NOW), "id", "severity") == [("cisa-kev:CVE-2024-0001", 70), ("cisa-kev:CVE-2024-0002", 80)]
    for bad in (cat(v("CVE-2024-0001"), count=3), cat(v("CVE-2024-0001"), v("CVE-2024-0001")), cat(v("CVE-1")), cat(v("CVE-2024-0001", "2024-02-31")), cat(v("CVE-2024-0001"), dateReleased="no")):
        assert parsers.known_exploits(one(spark, bad), "raw", NOW).count() == 0


def test_space_bulletins(spark):
    m = "Space Weather Message Code: ALTK07\r\nSerial Number: {}\r\n\r\n{}ALERT: Geomagnetic\r\nNOAA Scale: G3 - Strong"
    p = [{"product_id": "K", "issue_datetime": d, "message": m.format(n, c)} for d, n, c in (("2024-01-30 10:00:00.000", 5, ""), ("2024-01-30 12:00:00", 5, "CANCEL "), ("2024-01-29 00:00:00", 6, ""), ("2023-01-01 00:00:00", 7, ""))]
    assert rows(parsers.space_bulletins(one(spark, p), "raw", NOW), "id", "title", "severity") == [
        ("swpc:ALTK07/5", "Space weather bulletin · CANCEL ALERT: Geomagnetic", 15), ("swpc:ALTK07/6", "Space weather bulletin · ALERT: Geomagnetic", 70),
    ]


def test_coded_events(spark):
    def line(i, lat, lng, articles, quad):
        c = [""] * 61
        for n, x in {"event_id": i, "lat": lat, "lng": lng, "articles": articles, "quad": quad, "tone": "-2.5"}.items():
            c[parsers.EXPORT[n]] = str(x)
        return "\t".join(c)

    text = "\n".join([line(1, 1, 2, 5, 4), line(2, 0, 0, 5, 4), line(3, "", 2, 5, 4), line(4, 1, 2, 1, 4), line(5, 1, 2, 9, 1), line(6, 3, 2, 9, 4), "short\trow"])
    assert rows(parsers.coded_events(lines(spark, text), "line", "ord", 2, (4,), 10), "event_id", "lat") == [("1", 1.0), ("6", 3.0)]
    name = spark.range(1).select(parsers.earlier_window(F.lit("20240301000000"), 2).alias("n"))
    assert name.first().n == "20240229233000"


def test_malicious_urls(spark):
    text = r'''# comment
"id","dateadded"
"3","2024-01-03","http://user@1.2.3.4:8080/x","online","","malware_download","32-bit,elf,Mozi","l","r"
"1","2024-01-01","https://1.2.3.4/say""hi""","online","","malware_download","mirai","l","r"
"2","2024-01-02","http://bad.example/x","online","","malware_download","","l","r"
"4","2024-01-02","http://999.2.3.4/x"'''
    records = parsers.malicious_urls(lines(spark, text), "line")
    assert rows(records, "id", "url")[0] == (1, 'https://1.2.3.4/say"hi"')
    assert rows(parsers.host_groups(records), "ip", "port", "urls", "newest_id", "first_seen", "family") == [("1.2.3.4", 8080, 2, 3, "2024-01-01", "Mozi")]


def test_orbital_elements(spark):
    one_, two = "1 25544U 98067A   24030.50000000  .00016717  00000-0  10270-3 0  9005", "2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.49560000000010"
    got = rows(parsers.orbital_elements(lines(spark, f"ISS\n{one_}\n{two}\n{one_.replace('25544', '11111')}\n{two}"), "line", "ord"), "norad", "name", "inclination", "mean_motion")
    assert got == [("11111", "SAT-11111", 51.64, 15.4956), ("25544", "ISS", 51.64, 15.4956)]


def test_states_and_entities(spark):
    s = one(spark, ["AB12 ", " CALL ", "X", 0, 0, 10.0, 20.0, 1000.0, False, 100.0, 90.0])
    assert rows(parsers.position_states(s, "raw"), "hex", "callsign", "lat", "lng", "alt_ft", "speed_kt", "on_ground") == [("ab12", "CALL", 20.0, 10.0, 3281, 194, False)]
    m = spark.createDataFrame([(1, 10, 5.0, None, None), (1, 20, None, "Name", 80), (1, 15, 6.0, None, None)], "mmsi long, at_ms long, lat double, name string, type_code int")
    assert rows(parsers.ship_states(m), "mmsi", "lat", "name", "kind", "at_ms") == [(1, 6.0, "Name", "tanker", 20)]
    e = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "a", 2.0, 1.0), (3, "", 1.0, 1.0), (4, "b", 91.0, 1.0)], "ord long, id string, lat double, lng double")
    assert rows(parsers.accepted_entities(e, "s").where("accepted"), "entity_id", "lat") == [("ext-s-a", 2.0)]
