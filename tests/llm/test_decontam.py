import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        v = words(other)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bound", [decontam.BROADCAST_CHARS, -1])
def test_equals_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_CHARS", bound)
    rng = random.Random(3)
    vocab = ["aa", "Bb", "ça", "d1", "e", "日本", "g"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([13, 14, 30, 5, 3, 40, 20])]
    items += [(7, None), (8, ""), (9, "--- !!"), (2, "again other words for two here and more of that kind to be long enough now")]
    texts = [None, "", "x", "short aa"] + [" ".join(rng.choices(vocab, k=rng.choice([4, 13, 60, 300]))) for _ in range(25)]
    texts += ["pre " + items[5][1] + " post", items[2][1].replace(" ", "!\n").upper(), "q " * 700 + items[0][1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[-1])], "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam.contamination, "__defaults__", (*decontam.contamination.__defaults__[:-1], bound))
    got = decontam.contamination_digest(docs, bench).collect()
    assert len(got) == docs.count()
    at = dict(enumerate(texts)) | {None: texts[-1]}
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(at[r.doc_id], items), r
    assert decontam.contamination_digest(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontam.contamination_digest(docs.where("false"), bench).count() == 0
    kept = decontam.decontaminate(docs, bench, broadcast_chars=bound).count()
    assert kept == sum(not r.contaminated for r in got)


def test_very_many_items_with_one_window(spark):
    items = [(f"i{n}", "same") for n in range(60_000)]
    begun = time.time()
    index = decontam.Index(items)
    found = decontam._measure([b"same"] * 20_000, [(p, 1, index.items[b"same"]) for p in range(20_000)])
    assert found[:2] == (20_000, 20_000) and len(found[2]) == 60_000 and time.time() - begun < 20
