"""The continuity ledger against its rules, event by event, over several batches."""

import math
import os
import random

from pyspark.sql import functions as F

from strandline.operators import continuity
from strandline.plans.fusion import continuity_events, str01_continuity
from strandline.sources.adapters import NOW_MS

COLUMNS = "ord long, id string, title string, description string, category string, categories array<string>, at_ms long, lat double, lng double, reports array<string>, urls array<string>, nws boolean, content string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HOUR = 3_600_000
START = 10**12


def batch(rng, n, ids):
    rows = []
    for i in range(n):
        category = rng.choice(["earthquake", "flood", "conflict", "cyber"])
        located = rng.random() < 0.7
        title = " ".join(rng.choices(["river", "rises", "quake", "hits", "town", "alert", "bridge", "closed"], k=4))
        rows.append((
            i, f"e{rng.randrange(ids)}" if rng.random() > 0.02 else None, title if rng.random() > 0.02 else None, "News digest:\n• one\n• two" if rng.random() < 0.1 else None, category,
            [category] + ["flood"] * (rng.random() < 0.3) if rng.random() > 0.05 else None, START + rng.randrange(40 * HOUR) if rng.random() > 0.02 else None,
            rng.uniform(10, 14) if located else None, rng.uniform(20, 24) if located else float("nan"), [f"x|{rng.randrange(30)}"] if rng.random() < 0.15 else None,
            rng.sample([f"http://u/{k}" for k in range(30)], 2) if rng.random() < 0.2 else [], rng.random() < 0.2, str(rng.randrange(2)),
        ))
    return rows


def km(a, b):
    if any(x is None or math.isnan(x) for x in (a["lat"], a["lng"], b["lat"], b["lng"])):
        return None
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def meets(a, b):
    if a["id"] is not None and a["id"] == b["id"]:
        return True
    if (a["description"] or "").startswith("News digest") != (b["description"] or "").startswith("News digest"):
        return False
    if a["reports"] or b["reports"]:
        return bool(set(a["reports"] or ()) & set(b["reports"] or ()))
    if set(a["urls"] or ()) & set(b["urls"] or ()):
        return True
    if a["nws"] and b["nws"]:
        return False
    apart = abs((a["at_ms"] or 0) - (b["at_ms"] or 0))
    if apart > 12 * HOUR or a["category"] != b["category"] and not set(a["categories"] or ()) & set(b["categories"] or ()):
        return False
    wa, wb = set((a["title"] or "").split()), set((b["title"] or "").split())
    sim, d = len(wa & wb) / max(len(wa), len(wb)) if wa and wb else 0, km(a, b)
    if a["category"] == "earthquake":
        return sim >= 0.8 and d is not None and d <= 10 and apart <= HOUR // 6
    return sim >= 0.72 and (d is None or d <= 300) or sim >= 0.4 and d is not None and d <= 80 and apart <= 3 * HOUR


class Ledger:
    def __init__(self):
        self.entries, self.sequence = {}, 0

    def apply(self, events, now):
        self.entries = {k: e for k, e in self.entries.items() if now - e["last"] <= continuity.RETENTION_MS}
        out = {}
        for a in events:
            key = next((k for k, e in self.entries.items() if meets(a, e["event"])), None)
            if key is None:
                self.sequence += 1
                key = a["id"] if a["id"] is not None else ("null", self.sequence)
                self.entries[key] = {"event": a, "first": now, "last": now, "changed": now, "updates": 0, "seq": self.sequence}
                life = "new"
            else:
                e = self.entries[key]
                life = "updated" if e["event"]["content"] != a["content"] else "ongoing"
                if life == "updated":
                    self.sequence += 1
                    e.update(changed=now, updates=e["updates"] + 1, seq=self.sequence)
                e.update(event=a, last=now)
            e = self.entries[key]
            out[a["ord"]] = (key if isinstance(key, str) else None, a["id"], life, e["first"], e["last"], e["changed"], e["updates"], e["seq"])
        return out


def test_ledger_equals_the_sequential_version(spark):
    rng = random.Random(4)
    plain, stored, cursor = Ledger(), None, 0
    seen = set()
    for step, now in enumerate((START, START + 2 * HOUR)):
        rows = batch(rng, 140, 400 if step else 60)
        want = plain.apply([dict(zip(NAMES, r)) for r in rows], now)
        frame = spark.createDataFrame(rows, COLUMNS).withColumn("component", F.lit(1)).orderBy(F.rand(step))
        events, stored, cursor = continuity.apply_ledger(stored, frame, now, cursor)
        got = {r.ord: (r.stable_id, r.fused_id, r.lifecycle, r.first_ms, r.last_ms, r.changed_ms, r.update_count, r.change_sequence) for r in events.collect()}
        assert got == want
        assert cursor == plain.sequence
        assert stored.count() == len(plain.entries)
        seen |= {v[2] for v in got.values()}
    assert seen == {"new", "updated", "ongoing"}


def test_empty_batches(spark):
    empty = spark.createDataFrame([], COLUMNS)
    events, stored, cursor = continuity.apply_ledger(None, empty, START)
    assert events.count() == stored.count() == cursor == 0
    one = spark.createDataFrame(batch(random.Random(1), 1, 5), COLUMNS)
    _, stored, cursor = continuity.apply_ledger(stored, one, START, cursor)
    events, stored, cursor = continuity.apply_ledger(stored, empty, START + HOUR, cursor)
    assert events.count() == 0 and stored.count() == cursor == 1
    _, stored, cursor = continuity.apply_ledger(stored, empty, START + 50 * HOUR, cursor)
    assert stored.count() == 0 and cursor == 1


def test_an_id_takes_the_place_of_what_its_entry_became(spark):
    def event(o, ident, title, url):
        return (o, ident, title, "", "cyber", ["cyber"], START, None, None, [], [url], False, title)

    batches = [[event(0, "a", "mail server breach", "u1")], [event(0, "b", "mail server breach", "u1"), event(1, "b", "harbour crane fails", "u2"), event(2, "a", "vote count begins", "u3")]]
    plain, stored, cursor = Ledger(), None, 0
    for rows in batches:
        events, stored, cursor = continuity.apply_ledger(stored, spark.createDataFrame(rows, COLUMNS), START, cursor)
        want = plain.apply([dict(zip(NAMES, r)) for r in rows], START)
        assert {r.ord: (r.stable_id, r.lifecycle, r.change_sequence) for r in events.collect()} == {o: (v[0], v[2], v[7]) for o, v in want.items()}
    assert [(r.stable_id, r.id, r.place) for r in stored.collect()] == [("a", "a", 1)]


def test_query_equals_the_sequential_version(spark):
    rows = [{**r.asDict(), "title": " ".join(w for w in r.title.split() if len(w) > 2)} for r in continuity_events(spark, SF).orderBy("ord").collect()]
    plain = Ledger()
    want = plain.apply([r for r in rows if r["ord"] % 2 == 0], NOW_MS) | plain.apply([r for r in rows if r["ord"] % 2], NOW_MS + 90_000)
    got = {r.ord: (r.stable_id, r.fused_id, r.lifecycle, r.first_ms, r.last_ms, r.changed_ms, r.update_count, r.change_sequence) for r in str01_continuity(spark, SF).collect()}
    assert got == want


def test_events_that_all_match_make_no_row_a_pair(spark, monkeypatch):
    n = 400
    rows = [(i, f"e{i}", "river rises in the town", "", "flood", ["flood"], START + i, 10.0, 20.0, [], [], False, "1") for i in range(n)]
    most, whole = [], continuity.cut

    def counted(frame):
        frame = whole(frame)
        most.append(frame.count())
        return frame

    monkeypatch.setattr(continuity, "cut", counted)
    events, stored, cursor = continuity.apply_ledger(None, spark.createDataFrame(rows, COLUMNS), START)
    assert {r.stable_id for r in events.collect()} == {"e0"} and events.count() == n and stored.count() == cursor == 1
    assert max(most) <= 10 * n


def test_no_rows_are_sent_through_the_driver(spark):
    incoming = continuity.cut(continuity_events(spark, SF).where("ord < 20"))  # Spark takes it for as small as its file
    events, _, _ = continuity.apply_ledger(None, incoming, START)
    assert "BroadcastHashJoin" not in events._jdf.queryExecution().executedPlan().toString()
