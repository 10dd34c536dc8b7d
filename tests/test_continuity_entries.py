"""The entries that the continuity replay holds, against all of them one by one."""

import random

from strandline.operators import continuity
from strandline.operators.continuity import _Entries, _Said

HOUR = 3_600_000


def said(rng, titles):
    words = rng.choice(titles)
    place = rng.choice([(None, None), (1.0, 1.0), (1.0, 1.5), (3.0, 1.0)])
    category = rng.choice(["earthquake", "weather"])
    keys = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(20))]
    return _Said("c", keys, rng.random() < 0.2, rng.random() < 0.2, rng.randrange(0, 40 * HOUR, HOUR // 4), *place, words, category, frozenset([category, "x"]), tuple(words), () if place[0] is None else (7,))


def test_the_first_entry_that_an_event_meets_is_found():
    rng = random.Random(3)
    titles = [frozenset(rng.sample(range(9), 4)) for _ in range(12)]
    entries, found = _Entries(), 0
    for pos in range(600):
        s = said(rng, titles)
        want = next((e for e, (*_, o) in enumerate(entries.of) if set(o.keys) & set(s.keys) or s.meets(o)), None)
        assert entries.first(s, [7] if s.cells else []) == want
        if want is None:
            entries.begin(None, pos, s)
        else:
            entries.say(want, s)
            found += 1
    assert 50 < found < 550
    for e, (*_, o) in enumerate(entries.of):
        assert all(e in entries.by_key[k] for k in o.keys) and all(e in entries.by_title[o.at // continuity.WINDOW_MS][p] for p in o.pairs)
    assert sum(map(len, entries.by_key.values())) == len(entries.of)


def test_an_entry_that_says_the_same_keeps_its_places(monkeypatch):
    entries = _Entries()
    s = said(random.Random(1), [frozenset("abcd")])
    e = entries.begin(None, 0, s)
    monkeypatch.setattr(_Entries, "_drop", None)
    monkeypatch.setattr(_Entries, "_put", None)
    again = _Said("other", list(s.keys), s.digest, s.nws, s.at, s.lat, s.lng, s.words, s.category, s.categories, s.pairs, s.cells)
    entries.say(e, again)
    assert entries.of[e][3] is again


def test_times_of_a_small_clock_are_long(spark):
    row = "1L AS ord, 'a' AS id, 't' AS title, '' AS description, 'weather' AS category, array('weather') AS categories, 5L AS at_ms, 1D AS lat, 1D AS lng, array('r') AS reports, array('u') AS urls, false AS nws, 'c' AS content"
    events, after, _ = continuity.apply_ledger(None, spark.range(1).selectExpr(*row.split(", ")), 0)
    kinds = dict(events.dtypes) | dict(after.dtypes)
    assert {kinds[c] for c in ("first_ms", "last_ms", "changed_ms")} == {"bigint"}
