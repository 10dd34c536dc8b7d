"""Alias lists against brute force: reading, ranked search and match edges."""

import random
import re

from pyspark.sql import functions as F

from strandline.operators import aliases

LIST = "ord long, id string, schema string, name string, aliases array<string>"


def normal(text):
    return " ".join(re.sub(r"[^\w\s]|_", " ", text.lower()).split())


def entities(rng, n):
    words = ["Acme", "Ltd.", "Ivan", "Ó'Neil", "do", "a", "Trading-House", "北方", "x"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4)))
    return [(i, f"id{i}", rng.choice(["Person", "Company"]), name(), [name() for _ in range(rng.randint(0, 3))] if rng.random() < 0.9 else None) for i in range(n)]


def test_search_and_edges_equal_brute_force(spark):
    rng = random.Random(3)
    rows = entities(rng, 120)
    texts = ["acme", "Acme Ltd", "a", "do", "ivan  a", "O'NEIL", "ó neil", "北方", "北方 x", "trading", "...", "....", None, "zzzz", "me l", *[r[3] for r in rows[:20]]]
    asked = [(i, t) for i, t in enumerate(texts * 2)]
    keys = aliases.alias_keys(spark.createDataFrame(rows, LIST).withColumn("key", F.lit("clashing")))
    frame = spark.createDataFrame(asked, "entity long, text string").withColumn("q", F.lit("clashing"))
    edges = {}
    for r in aliases.match_edges(frame.unionByName(frame), keys).collect():
        edges.setdefault(r.entity, []).append((r.place, r.id))
    ranked = {}
    for r in aliases.search(frame, keys, 7, "Person").collect():
        ranked.setdefault(r.q, []).append((r.place, r.id, r.rank))
    want_ranked = {}
    for entity, text in asked:
        q = normal(text or "")
        names = [(r[1], r[2], normal(r[3]), [normal(a) for a in r[4] or ()]) for r in rows]
        exact = [n[0] for n in names if q and q in (n[2], *n[3])]
        found = exact or [n[0] for n in names if q and any(q in k for k in (n[2], *n[3]))]
        want = found[:5] if text and len(text) >= 3 else []
        assert [i for _, i in sorted(edges.get(entity, []))] == want
        if text and len(text) >= 4 and q:
            rank = lambda n: 0 if n[2] == q else 1 if q in n[3] else 2 if q in n[2] else 3 if any(q in k for k in n[3]) else 9
            hits = sorted((rank(n), at, n[0]) for at, n in enumerate(names) if n[1] == "Person" and rank(n) < 9)[:7]
            if hits:
                want_ranked[q] = [(p + 1, i, k) for p, (k, _, i) in enumerate(hits)]
    assert {q: sorted(v) for q, v in ranked.items()} == want_ranked
    assert any(k == 1 for v in want_ranked.values() for _, _, k in v) and any(k == 3 for v in want_ranked.values() for _, _, k in v)


def test_files(spark, tmp_path):
    text = 'id,Name,aliases,countries,extra\r\n1,"A ""b"", c\nd", x ; ;y,"us;gb",1\r\n2,,z,,\r\n,Plain,,,\r\n'
    (tmp_path / "list.csv").write_bytes(text.encode())
    rows = aliases.read_entities(spark, str(tmp_path / "list.csv")).orderBy("ord").collect()
    assert [(r.id, r.schema, r.name.replace("\r", ""), r.aliases, r.countries) for r in rows] == [("1", "LegalEntity", 'A "b", c\nd', ["x", "y"], ["us", "gb"]), ("", "LegalEntity", "Plain", [], [])]
    assert rows[0].last_seen is None and rows[0].programs == []


def test_empty_lists(spark):
    keys = aliases.alias_keys(spark.createDataFrame([(1, "a", "Person", "!!", [None, "?"])], LIST))
    asked = spark.createDataFrame([(1, "some")], "entity long, text string")
    assert keys.count() == 0
    assert aliases.match_edges(asked, keys).count() == aliases.search(asked, keys).count() == aliases.match_edges(asked.limit(0), keys).count() == 0
