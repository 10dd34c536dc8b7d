import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import katz


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split() + [b"<end>"]
    train = [split(t) for d, t in rows if not held(d)]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    ctx = Counter(u for u, _ in bi.elements())
    n, v = sum(uni.values()), len(uni)

    def discounts(c):
        h = Counter(c.values())
        return katz.Discounts.of([0, *[h[r] for r in range(1, 8)]]).d

    d1, d2 = discounts(uni), discounts(bi)
    star = lambda c, d: c * d[c] if c <= 5 else c
    off = sum(star(c, d1) for c in uni.values())
    whole = n if n - off > 1e-9 else n + 1
    low = lambda w: star(uni[w], d1) / whole if uni[w] else (whole - off) / whole
    after = {}
    for (u, w), c in bi.items():
        after.setdefault(u, []).append((w, c))

    def p(w, u):
        if not ctx[u]:
            return low(w)
        gone = sum(c - star(c, d2) for _, c in after[u])
        total = ctx[u] if gone > 1e-12 else ctx[u] + 1
        if bi[u, w]:
            return star(bi[u, w], d2) / total
        return (1 - sum(star(c, d2) for _, c in after[u]) / total) / (1 - sum(low(x) for x, _ in after[u])) * low(w)

    out = []
    for d, t in rows:
        ts = split(t)
        out.append((str(d), held(d), len(ts), sum(uni[w] > 0 for w in ts), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), sum(math.log10(p(w, u)) for u, w in zip([None, *ts], ts))))
    return out, p, uni, ctx


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "PART_TOKENS", block // 2)
    rng = random.Random(8)
    zipf = [f"W{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(zipf, k=rng.randint(0, 90)))) for i in range(120)] + [(500, None), (501, "the  the\tthe"), (7, "dup row"), (7, "dup row"), (None, "none é")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in katz.score_corpus(frame).select(F.col("doc_id").cast("string"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").fillna("None").collect())
    want, p, uni, ctx = brute(rows)
    for g, w in zip(got, sorted(want)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9), (g, w)
    for u in list(ctx)[:40]:
        assert sum(p(w, u) for w in uni) + p(b"never seen", u) == pytest.approx(1, abs=1e-9)


def test_empty_and_tiny(spark):
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    assert katz.score_corpus(docs.where("false")).count() == 0
    only_held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1]
    got = katz.score_corpus(spark.createDataFrame([(d, "a b") for d in only_held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite([r.score, r.base_score]).all() for r in got)
