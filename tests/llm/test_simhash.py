import itertools
import random

import xxhash
from pyspark.sql import functions as F

from strandline.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    low = {i: i for i in range(len(rows))}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
            a, b = find(i), find(j)
            low[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return {i: min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(rows))}


def test_whole_result_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 2, 3, 40, 80, 300)]
    texts = base + [base[5] + " tail"] * 2 + [base[6].upper(), base[6] + " X", None, " \t\n", "Ünï côdé wörd　x", base[4]]
    texts += [" ".join(base[6].split()[: 300 - k]) for k in range(1, 12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, base[5]), (None, "alone here")]
    got = simhash.simhash_components(
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    ).collect()
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    low = brute_components(prints)
    want = sorted((str(d), f"{p:016x}", str(low[i])) for i, (d, p) in enumerate(prints))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_keep_reachability_in_large_groups(spark, monkeypatch):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    near = {centre} | {centre ^ (1 << a) for a in range(64)} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    lone = {rng.getrandbits(64) for _ in range(50)}
    values = sorted(near | lone)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for pairwise in (4, 1000):
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        links = simhash.near_links(frame).collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
        low = {i: i for i in range(len(values))}
        at = {v: i for i, v in enumerate(signed)}

        def find(i):
            while low[i] != i:
                i = low[i]
            return i

        for a, b in links:
            x, y = find(at[a]), find(at[b])
            low[max(x, y)] = min(x, y)
        want = brute_components([(i, v) for i, v in enumerate(values)])
        assert {i: find(i) for i in low} == {i: want[i] for i in low}


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 2), (None, "a b c d", 3), (7, "other words here now", 4), (9, None, 5), (10, "", 6)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, gone_id long"))
    assert sorted((r.doc_id, r.gone_id) for r in kept.collect()) == [(2, 2), (7, 4), (9, 5)]
    assert simhash.simhash_components(kept.where("false")).count() == 0
    assert simhash.drop_near_duplicates(kept.where("false")).count() == 0


def brute_wide(text, shingle=5):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or {b" ".join(words)}
    hs = [int.from_bytes(xxhash.xxh3_128_digest(g, 42), "big") for g in grams]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, linked):
    low = {v: v for v in values}

    def find(v):
        while low[v] != v:
            v = low[v]
        return v

    for x, y in linked:
        x, y = find(x), find(y)
        low[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def wide_frame(spark, values):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return spark.createDataFrame([(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values], "a long, b long")


def test_ring_links_equal_all_pairs(spark):
    rng = random.Random(3)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(128), n))
    centres = [rng.getrandbits(128) for _ in range(30)]
    values = set(centres) | {flip(c, rng.randint(1, 26)) for c in centres for _ in range(6)} | {flip(centres[0], rng.randint(1, 9)) for _ in range(150)}
    values = sorted(values)
    for bits, wide in ((9, 19), (3, 128), (0, 4), (12, 24)):
        near = [(x, y) for x, y in itertools.combinations(values, 2) if (x >> 64 ^ y >> 64).bit_count() <= bits and (x ^ y).bit_count() <= wide]
        want, near = classes(values, near), set(near)
        for chain, hot in ((None, 4096), (3, 4096), (2, 16)):
            if bits == 12 and chain == 3:
                continue
            links = {tuple(sorted((int(r.src, 16), int(r.dst, 16)))) for r in simhash.ring_links(wide_frame(spark, values), bits, wide, chain, hot).collect()}
            assert classes(values, links) == want
            assert len(links) < 40 * len(values)
    assert simhash.ring_links(wide_frame(spark, values).where("false"), 9, 19).count() == 0


def test_every_pair_within_the_bits_shares_a_key_once():
    rng = random.Random(8)
    for bits, chain in ((9, 2), (9, 3), (2, 2), (5, 4)):
        ring = simhash.Ring(bits, chain)
        for _ in range(40):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits)))
            met = 0
            for i, masks in enumerate(ring.masks):
                own = [((v >> ring.starts[i] | v << 64 - ring.starts[i]) & int(ring.low(i, chain))) for v in (x, y)]
                for v, w in (own, own[::-1]):
                    met += sum(v ^ m == w for m, low in masks if m and not v >> low & 1)
                met += own[0] == own[1]
            assert met >= 1


def test_wide_fingerprints_and_near_copies(spark):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(900)]
    texts, copies = [], {}
    for n in range(24):
        base = rng.choices(words, k=rng.randint(150, 400))
        texts.append(" ".join(base))
        changed = base[:]
        for at in rng.sample(range(len(base)), max(1, len(base) // 200)):  # one word in 200: about 19 of 20 shingles stay
            changed[at] = "other"
        copies[len(texts)] = len(texts) - 1
        texts.append(" ".join(changed))
    texts += ["", None, "one two", "One  TWO", " ".join(rng.choices(words, k=60_000))]
    for t in texts[:6] + texts[-5:-1]:
        assert int.from_bytes(simhash.wide_fingerprint(t), "big") == brute_wide(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert sum(c not in kept for c in copies) >= 22 and all(c in kept for c in copies.values())
    assert 48 in kept and 49 not in kept and 50 in kept and 51 not in kept and 52 in kept
    assert simhash.expected_bits(0.8, 64) == 9 and simhash.expected_bits(0.8, 128) == 19 and simhash.expected_bits(1.0, 64) == 0


def test_isolated_pairs_at_the_similarity_are_linked():
    """Of pairs with Jaccard similarity 0.8 or more nine in ten are linked in each band; unrelated texts never."""
    rng, vocabulary, bands = random.Random(5), [f"w{i}" for i in range(20_000)], {}
    bits, wide = simhash.expected_bits(0.8, 64), simhash.expected_bits(0.8, 128) + simhash.SLACK
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def linked(x, y):
        p, q = (simhash.wide_fingerprint(" ".join(t), 5, simhash.PRINTS) for t in (x, y))
        differ = [int.from_bytes(p[i : i + 16], "big") ^ int.from_bytes(q[i : i + 16], "big") for i in range(0, len(p), 16)]
        return any((d >> 64).bit_count() <= bits and d.bit_count() <= wide for d in differ)

    for _ in range(700):
        x = rng.choices(vocabulary, k=rng.randint(200, 800))
        y = x[:]
        for at in rng.sample(range(len(x)), rng.randint(1, max(1, len(x) // 45))):
            y[at] = rng.choice(vocabulary)
        a, b = shingles(x), shingles(y)
        if (j := len(a & b) / len(a | b)) >= 0.8:
            bands.setdefault(int(j * 20), []).append(linked(x, y))
    assert set(bands) == {16, 17, 18, 19} and all(sum(v) >= 0.9 * len(v) for v in bands.values())
    assert not any(linked(rng.choices(vocabulary, k=300), rng.choices(vocabulary, k=300)) for _ in range(200))


def test_links_of_any_print_join_texts(spark):
    rng = random.Random(6)
    words, texts = [f"word{i}" for i in range(5000)], []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(250, 500))
        changed = base[:]
        for at in rng.sample(range(len(base)), len(base) // 60):
            changed[at] = "other"
        texts += [" ".join(base), " ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert {i for i in range(0, 120, 2)} <= kept and len(kept) <= 66
