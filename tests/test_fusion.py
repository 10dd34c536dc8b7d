"""Fusion against a plain all-pairs, row-by-row version over random signals, and in any row order."""

import math
import random

from pyspark.sql import functions as F

from strandline.operators import fusion
from strandline.operators.graph import connected_components

COLUMNS = (
    "ord long, id string, title string, description string, category string, at_ms long, lat double, lng double, location_confidence double, severity double, source_id string, source string, "
    "kind string, independent boolean, weight double, upstream_id string, url string, withdrawn boolean"
)


def signals(seed, n=160):
    rng, rows = random.Random(seed), []
    for i in range(n):
        source = rng.choice(["noaa-nws", "usgs-earthquakes", "news:a", "gdacs", "x1", "x2"])
        category = rng.choice(["earthquake", "flood", "conflict", "cyber"])
        key = f"{'usgs' if source.startswith('usgs') else 'gdacs' if source == 'gdacs' else 'e'}:{rng.randrange(n)}"
        title = " ".join(rng.choices(["river", "rises", "quake", "hits", "town", "alert"], k=4))
        located = rng.random() < 0.7
        rows.append((
            i, key, title if rng.random() > 0.02 else "abc", "", category, 10**12 + rng.randrange(20 * 3_600_000), rng.uniform(10, 10.6) if located else None, rng.uniform(20, 20.6) if located else None,
            0.5, float(rng.randrange(100)), source, source, "media", rng.random() < 0.5, round(rng.uniform(0.3, 1.5), 2), str(rng.randrange(40)) if rng.random() < 0.2 else None,
            f"http://u/{rng.randrange(40)}" if rng.random() < 0.3 else None, rng.random() < 0.1,
        ))
    return rows


NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def km(a, b):
    if None in (a["lat"], b["lat"]):
        return None
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


FAMILY = {"earthquake": "n", "flood": "n", "conflict": "h", "cyber": "s"}


def hazard(a, b):
    return any(a["id"].startswith(p) and b["id"].startswith(p) and a["source_id"] == b["source_id"] == s and a["id"] != b["id"] for s, p in (("usgs-earthquakes", "usgs:"), ("gdacs", "gdacs:")))


def report(a):
    return (a["source_id"], a["upstream_id"]) if a["upstream_id"] else None


def match(a, b):
    if a["withdrawn"] != b["withdrawn"]:
        return False
    if a["id"] == b["id"]:
        return True
    if hazard(a, b):
        return False
    if report(a) or report(b):
        return report(a) == report(b)
    if a["url"] and a["url"] == b["url"]:
        return True
    if a["source_id"] == b["source_id"] == "noaa-nws":
        return False
    apart, d = abs(a["at_ms"] - b["at_ms"]), km(a, b)
    if apart > 8 * 3_600_000:
        return False
    wa, wb = set(a["title"].split()), set(b["title"].split())
    sim = len(wa & wb) / max(len(wa), len(wb))
    alike, same = sim >= 0.68 and (d is None or d <= 250), a["category"] == b["category"]
    if "news:a" in (a["source_id"], b["source_id"]):
        return alike
    if same and a["category"] == "earthquake":
        return apart <= 900_000 and d is not None and d <= 25
    if alike:
        return True
    if FAMILY[a["category"]] != FAMILY[b["category"]] or d is None:
        return False
    return d <= 60 and sim >= 0.24 or same and d <= 25 and apart <= 3_600_000


def exact(a, b):
    return a["id"] == b["id"] or (report(a) == report(b) if report(a) or report(b) else bool(a["url"]) and a["url"] == b["url"])


def greedy(rows):
    clusters = []
    for r in sorted((r for r in rows if len(r["title"]) >= 4), key=lambda r: (-r["at_ms"], r["ord"])):
        for c in clusters:
            if any(hazard(m, r) for m in c):
                continue
            if not any(exact(m, r) and match(m, r) for m in c) and any("news:a" in (m["source_id"], r["source_id"]) and not match(m, r) for m in c):
                continue
            if any(match(m, r) for m in c):
                c.append(r)
                break
        else:
            clusters.append([r])
    return {r["ord"]: c[0]["ord"] for c in clusters for r in c}


def test_clusters_equal_the_sequential_version(spark):
    for seed in (1, 2):
        rows = signals(seed)
        want = greedy([dict(zip(NAMES, r)) for r in rows])
        for order in ("ord", F.rand(3)):
            prepared = fusion.prepare(spark.createDataFrame(rows, COLUMNS).orderBy(order))
            assert {r.ord: r.leader for r in fusion.cluster(prepared).collect()} == want


def test_fused_events(spark):
    frame = spark.createDataFrame(signals(3, 60), COLUMNS)
    fused = fusion.fuse(frame, 10**12 + 30 * 3_600_000, None).collect()
    assert sum(r.signals for r in fused) == frame.where("length(title) >= 4").count()
    assert all(0 <= r.priority <= 100 and r.fused_id.startswith("evt-") for r in fused)
    assert fused == sorted(fused, key=lambda r: (-r.priority, -r.last_seen_ms, r.leader))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(300, 301 + i) for i in range(50)] + [(500, 500), (None, 3)]
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None:
            low[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in low}
