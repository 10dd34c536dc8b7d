"""Blocks of pages, news as signals, dated lists, digests and past reviews against plain versions, with nulls, ties and empty tables."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.functions import geo, lookups
from strandline.operators import bulletins as ops


def test_blocks_of_pages_equal_a_plain_parser(spark):
    texts = ["First one. Then more of it", "short", "No end here but <b>tags</b> &amp; all", "x" * 200 + ". y", "Is it? Yes\nit is, and so on", "", "A line first\nand a second one. Third"]
    rng = random.Random(4)
    pages = [(i, rng.choice(["h1", "h2", None]), None if i == 5 else "head" + "".join(f"<m>{rng.choice(texts)}</m>" for _ in range(rng.randrange(9))) + ("<m>an unclosed block of text" if i % 3 == 0 else "")) for i in range(30)]
    want = []
    for i, host, html in pages:
        for place, block in enumerate((html or "").split("<m>")[1:], 1):
            said = re.sub(r"[^\S\n]+", " ", re.sub(r"<[^>]+>", " ", block.split("</m>")[0]).replace("&amp;", "&")).strip(" ")
            if "</m>" in block and len(said) >= 20:
                first = re.split(r"\n|(?<=[.!?])\s+", said)[0] or said
                want.append((i, host, place, said, first if len(first) <= 160 else first[:157] + "..."))
    frame = spark.createDataFrame(pages, "page long, host string, html string")
    got = ops.page_blocks(frame.repartition(3), "html", "<m>", "</m>").select("page", "host", "place", "description", "title")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for last in (False, True):
        kept = defaultdict(list)
        for row in sorted(want, key=lambda r: (r[0], r[2]), reverse=last):
            kept[row[1]].append((row[0], row[2]))
        found = ops.per_source(got, "host", ["page", "place"], 4, last).collect()
        assert sorted((r.page, r.place) for r in found) == sorted(x for rows in kept.values() for x in rows[:4])
    assert ops.page_blocks(frame.limit(0), "html", "<m>", "</m>").collect() == []


def test_news_become_signals_and_evidence(spark):
    schema = "item string, title string, description string, published_ms long, risk int, confidence string, source_count int, evidence_weight double, primary_source string, link string"
    items = spark.createDataFrame([
        ("a", "Earthquake in Kyiv", "strong", 1, 10, "high", 2, 2.2, "BBC", "https://x.example/1"), ("b", "Daily briefing", "- Kyiv\n- Paris", 2, 0, "medium", 0, 0.1, "Own Desk", ""),
        ("c", None, None, None, None, None, None, None, "***", None),
    ], schema)
    s = {r.id: r for r in ops.news_signals(items).collect()}
    assert (s["news:a"].severity, s["news:a"].category, s["news:a"].location) == (98, "earthquake", "Kyiv, Ukraine")
    assert (s["news:b"].severity, s["news:b"].digest, s["news:b"].lat, s["news:b"].location_confidence) == (13, True, None, 0.0)
    assert (s["news:c"].severity, s["news:c"].category, s["news:c"].location) == (10, "other", None)
    members = spark.createDataFrame([("a", "BBC"), ("a", "WarTranslated"), ("a", "WarTranslated"), ("z", "BBC")], "item string, source string")
    got = sorted((r.id, r.source_id, r.kind, r.independent, r.weight, r.url) for r in ops.news_evidence(items, members).collect())
    assert got == [
        ("news:a", "news:bbc", "broadcaster", False, 1.1, "https://x.example/1"), ("news:a", "news:wartranslated", "osint", True, 1.1, None),
        ("news:b", "news:own-desk", "editorial", True, 0.4, None), ("news:c", "news:source", "editorial", True, 0.4, None),
    ]


def test_dated_lists_and_wallets(spark):
    day, now = ops.DAY_MS, 200 * ops.DAY_MS
    rows = [("A", "w", 2, 0, now, 1.0, 2.0, 3.0), ("A", "b", 1, 5, now - day, None, 2.0, 3.0), ("A", "b", 1, 9, now, 9.0, 2.0, 3.0), ("B", "b", 1, 1, now - 120 * day, 1.0, None, None),
            ("C", "b", 1, 2, now - 119 * day, None, None, None), ("D", "b", 1, 3, now + 1, 1.0, None, None), (None, "b", 1, 4, now, 1.0, None, None), ("", "b", 1, 4, now, 1.0, None, None), ("E", "b", 1, 4, None, 1.0, None, None)]
    found = spark.createDataFrame(rows, "cve string, term string, rank int, place int, published_ms long, v31 double, v30 double, v2 double")
    assert sorted(map(tuple, ops.dated_vulnerabilities(found, now, 400).collect())) == [("A", "b", now - day, 2.0), ("C", "b", now - 119 * day, None)]
    assert [r.cve for r in ops.dated_vulnerabilities(found, now, 3).collect()] == ["A"]
    names = [("0x" + "aB" * 20, None), ("bc1" + "q" * 30, now), ("3" + "k" * 25, now - 9 * day), ("T" + "z" * 33, now - 8 * day), ("4A" + "z" * 93, now), ("0x12", now), ("1" + "0" * 30, now), (None, now)]
    entries = spark.createDataFrame([(i, *x) for i, x in enumerate(names)], "i int, name string, first_seen_ms long")
    kept = ops.designated_wallets(entries, lookups.address_asset(F.col("name")), now, 8)
    assert sorted((r.i, r.asset) for r in kept.collect()) == [(0, "ETH"), (1, "BTC"), (3, "TRX"), (4, "XMR")]
    spread = ops.spread(kept.withColumn("g", F.lit("all")), "g", "asset", [-F.coalesce("first_seen_ms", F.lit(0)), F.col("i")])
    assert [tuple(r) for r in spread.collect()] == [("all", 4, "1 BTC, 1 XMR, 1 TRX, 1 ETH")]


def test_digest_of_alerts_equals_a_plain_one(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        group = rng.choice(["a", "b", None])
        rows.append((group, rng.choice(["quake", "news", "weather", "conflict", None]), i, rng.choice([None, 1.0, 4.9, 5.0]), rng.choice([None, 0, 7, 8]) if group == "a" else 1, f"title {i} " + "y" * 60, rng.choice([None, "", "flood", "storm", "heat", "snow"]), rng.choice([None, False]) if group != "b" else False))
    rows.append(("c", "news", 1, None, None, "A severe thing", None, None))
    rows.append(("d", "conflict", 1, None, None, None, None, None))
    frame = spark.createDataFrame(rows, "g string, kind string, ord int, magnitude double, risk int, title string, type string, high boolean")
    got = {r.g: r for r in ops.alert_digest(frame.repartition(3), "g").collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, r in got.items():
        mine = [x for x in rows if x[0] == g]
        news = [x for x in mine if x[1] == "news"]
        assert r.hot == sum((x[4] or 0) >= 8 for x in news) and r.conflicts == sum(x[1] == "conflict" for x in mine)
        assert r.top == (sorted(news, key=lambda x: (-(x[4] or 0), x[2]))[0][5][:48] if news else None)
        assert r.types == ", ".join(list(dict.fromkeys(x[6] for x in mine if x[1] == "weather" and x[6]))[:3])
        assert r.strong == sum(x[1] == "quake" and (x[3] or 0) >= 5 for x in mine)
    assert (got["c"].level, got["d"].level, got["d"].top) == ("ELEVATED", "NOMINAL", None)
    assert ops.alert_digest(frame.limit(0), "g").collect() == []


def test_past_reviews_hold_both_sides(spark):
    good = ("now", "2024-01-02T00:00:00Z", "l", "r", "p", "q", ops.PAIR_REASONS[1], 1.0, 2.0)
    change = lambda **kw: tuple(kw.get(k, v) for k, v in zip("epoch sampled_at left_event right_event left_provider right_provider reason distance_km time_difference_seconds".split(), good))
    rows = [
        good, good, change(right_event="l"), change(epoch="old"), change(epoch=None), change(sampled_at="soon"), change(left_provider=""), change(left_provider=None), change(reason="x"), change(distance_km=-1.0),
        change(distance_km=float("nan")), change(distance_km=None), change(time_difference_seconds=float("inf")), change(time_difference_seconds=-0.5),
    ]
    reports = spark.createDataFrame(rows, "epoch string, sampled_at string, left_event string, right_event string, left_provider string, right_provider string, reason string, distance_km double, time_difference_seconds double")
    pairs = ops.historical_pairs(reports, "now")
    assert Counter(r.fault for r in pairs.collect()) == {None: 2, "epoch": 1, "time": 1, "field": 2, "reason": 1, "distance": 3, "seconds": 2}
    plan = spark.createDataFrame([("l", "propose", "x", ["z", "a"]), ("r", "keep", None, None), ("other", "propose", "x", None)], "event_id string, action string, proposed string, blockers array<string>")
    got = {r.event_id: tuple(r)[1:] for r in ops.hold_groups(plan, pairs).collect()}
    held = "historical_pair_requires_review"
    assert got == {"l": ("manual_review", None, ["a", held, "z"], 2), "r": ("manual_review", None, [held], 1), "other": ("propose", "x", [], 0)}


def test_components_are_incomplete_with_a_missing_or_ambiguous_identity(spark):
    rng, rows = random.Random(8), []
    for stored in range(60):
        for identity in range(rng.randrange(1, 4)):
            groups = rng.choice([[1], [1], [1], [2], [], [1, 2]]) if stored % 3 == 0 else [1 + (identity > 0 and stored % 3 == 1)]
            for g in groups or [None]:
                rows.append((stored, 2 if stored == 7 and identity else 1, f"{stored}-{identity}", stored not in (9, 10) or identity > 0, None if g is None else stored // 4 * 10 + g))
    events, member = {}, defaultdict(set)
    for s in {r[0] for r in rows if r[3]}:
        mine = [r for r in rows if r[0] == s]
        per = defaultdict(set)
        for r in mine:
            per[r[2]] |= {r[4]} - {None} if r[3] else set()
        events[s] = any(not r[3] for r in mine) or any(len(g) != 1 for g in per.values()) or len({r[1] for r in mine if r[3]}) > 1
        member[s] = set().union(*per.values())
    want, left = Counter(), set(events)
    while left:
        ids, groups = {left.pop()}, set()
        while True:
            groups = set().union(*(member[s] for s in ids))
            more = {s for s in events if member[s] & groups} | ids
            if more == ids:
                break
            ids = more
        left -= ids
        bad = any(events[s] for s in ids)
        want[(len(ids), len(groups), bad, "review_missing_or_ambiguous_observations" if bad else "review_overlap" if len(ids) > 1 < len(groups) else "review_merge" if len(ids) > 1 else "review_split" if len(groups) > 1 else "review_consistent")] += 1
    links = spark.createDataFrame(rows, "stored int, revision int, identity string, news boolean, current int")
    got = Counter((r.stored, r.current, r.incomplete, r.action) for r in ops.reviewed_components(links.repartition(3)).collect())
    assert got == want
    assert ops.reviewed_components(links.limit(0)).collect() == []


def test_labels_of_durations_altitudes_and_manoeuvres(spark):
    rows = [(0.0, None, True, None, "turn", None, None, None), (29.0, 10.0, False, 4, "depart", None, "A1", None), (3600.0, None, None, 15, "roundabout", "left", " B ", 2), (5430.0, float("nan"), False, 13, "continue", "straight", "C", None),
            (3569.9, 3000.0, None, 99, "unknown", "left", "", None), (60.0, -100.0, False, 26, "rotary", "", "D", 0), (60.0, 1.0, False, 9, "arrive", "left", "E", None), (60.0, 1.0, False, 7, "fork", None, None, None), (60.0, 1.0, False, 1, None, None, None, None)]
    f = spark.createDataFrame(rows, "s double, m double, g boolean, n int, kind string, way string, road string, exit int")
    got = f.select(geo.format_duration(F.col("s")), geo.format_altitude(F.col("m"), F.col("g")), lookups.manoeuvre_kind(F.col("n")), lookups.instruction(F.col("kind"), F.col("way"), F.col("road"), F.col("exit"))).collect()
    assert [tuple(r) for r in got] == [
        ("1 min", "Ground", "straight", "Continue"), ("1 min", "25 ft", "arrive", "Head out on A1"), ("1 hr", "—", "roundabout", "At the roundabout, take exit 2 onto B"), ("1 hr 31 min", "—", "left", "Continue onto C"),
        ("59 min", "9,850 ft", "straight", "Turn left"), ("1 min", "-325 ft", "merge", "Enter the roundabout onto D"), ("1 min", "0 ft", "right", "You have arrived at your destination"), ("1 min", "0 ft", "straight", "Keep straight"), ("1 min", "0 ft", "depart", "Continue"),
    ]


def test_centroids_and_origins(spark):
    z = spark.createDataFrame([("DE", 51.0, 10.0), ("FR", 46.0, 2.0)], "code string, lat double, lng double")
    rows = spark.createDataFrame([(0, " de ", 1.0), (1, "fr", 3.0), (2, None, 2.0), (3, "XX", 2.0)], "i int, c string, w double")
    got = {r.i: (r.code, round(r.lat, 3), round(r.lng, 3)) for r in ops.at_centroids(rows, F.col("c"), z, "i").collect()}
    assert got == {0: ("DE", 49.0, 8.0), 1: ("FR", 45.026, 2.75)}
    top = ops.top_origins(rows, F.upper(F.trim("c")), "w", z, 3).collect()
    assert [(r.code, r.share) for r in top] == [("FR", 37.5)] and ops.top_origins(rows.limit(0), F.col("c"), "w", z, 3).collect() == []
