import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from strandline.llm import pii

FIXED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def brute(text):
    out = []
    for kind, pattern in FIXED.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_equals_the_plain_patterns():
    rng = random.Random(4)
    bits = ["a", "@", ".", "b.c", "-", "1", "255", "256", "4111111111111111", "+1 (20", ") 555-77", " ", "é", "@@", "x@y.z", "٣", "4111 1111 1111 1111", "%", "1.2.3.4", "0001"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        assert pii.base_spans(text)[0] == brute(text), text


def test_bootstrap_finds_unseen_identifiers(spark):
    seeds = [f"Contact e-mail: user{i}@mail.example.com today." for i in range(6)]
    hexes = [f'the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ends' for i in range(20)]
    texts = seeds + [
        "Contact e-mail: bob_42_home today.", 'my token = "zq81-77ab-xx90" ends', "Note: nothing1234 here", "Note: plain", "score = 123456", None, "", "card: 4111111111111112 no",
        "the token = word", *[f"card: {c}" for c in ("4111111111111111", "5500005555555559", "340000000000009")],
    ]
    texts += hexes
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(6, texts[6])], "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("kind", F.lit(1))
    got = pii.find_pii(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = brute(texts[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in FIXED)
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    bob = texts[6].index("bob")
    assert spans[6] == f"email:{bob}:{bob + 11}"
    zq = texts[7].index("zq")
    assert spans[7] == f"secret:{zq}:{zq + 14}"
    assert all(spans[i] == "" for i in range(8, 15))
    assert pii.find_pii(docs.where("false")).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert masked[0] == "Contact e-mail: [email] today." and masked[6] == "Contact e-mail: [email] today." and masked[10] == texts[10] and masked[11] is None
    assert pii.mask_pii(docs).columns == docs.columns


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "a." * 150_000 + "@", "+1 " + "1 " * 100_000, "1." * 150_000):
        pii.base_spans(text)


def found(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}, {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}


def test_long_values_are_whole_and_do_not_fail(spark):
    digits = "ab3" * 1700
    texts = ["0" * 5000 + ".1.1.1", f"the token = {digits} ends", "1" * 300_000 + ".1.1.1", f"x key_{'9' * 9000} y"]
    spans, masked = found(spark, texts)
    assert spans[0] == f"ip:0:{len(texts[0])}" and spans[1] == f"secret:12:{12 + len(digits)}" and spans[2] == spans[3] == ""
    assert masked[1] == "the token = [secret] ends"


def test_many_cues_take_time_in_proportion():
    begun = time.time()
    for text in ("x: a@b.cd y: q12345 " * 100_000, "k=v12345 " * 100_000, "card: 4111111111111112 " * 100_000):
        slots = pii.Slots(text, pii.ContextHashes())
        assert len(slots.patterns()) == len(slots.found) >= 100_000
        slots.plain()
    assert time.time() - begun < 60


def test_contexts_in_prose_on_both_sides(spark):
    rng = random.Random(6)
    filler = ["we met on the hill and talked of 12 things", "at home it was cold", "account of the day", "call me at noon then"]
    texts = [f"You can call me at +1 (212) 555-{1000 + i} any time." for i in range(6)]
    texts += ["You may call me at ext77-402 any time.", "Please write to <b01_home> soon.", "the key=zz91-home is", "plain key=word here"]
    texts += [f"Please write to <u{i}@m.example.com> soon." for i in range(5)]
    texts += [f"the key={hashlib.md5(str(i).encode()).hexdigest()} is" for i in range(6)]
    texts += [rng.choice(filler) for _ in range(40)]
    spans, _ = found(spark, texts)
    assert spans[6].startswith("phone:") and spans[7].startswith("email:") and spans[8] == "secret:8:17" and spans[9] == ""
    assert all(s == "" for i, s in spans.items() if i >= 21)


def test_a_context_that_plain_words_share_teaches_nothing(spark):
    texts = [f"we went to u{i}@m.example.com after it" for i in range(4)] + ["we went to room12-b after it"] + [f"we went to {w} after it" for w in ("town", "sea", "work")]
    assert found(spark, texts)[0][4] == ""


def test_chains_of_any_length_are_followed(spark):
    hops = 7
    texts = [f"hop0: u{i}@m.example.com" for i in range(3)]
    for k in range(1, hops):  # three identifiers of each hop stand after the last hop's label and after their own
        texts += [f"hop{k - 1}: id{k}-00{i}" for i in range(3)] + [f"hop{k}: id{k}-00{i}" for i in range(3)]
    texts.append(f"hop{hops - 1}: last-12345")
    spans, _ = found(spark, texts)
    assert all(spans[i].startswith("email:") for i in range(len(texts)))


def brute_bootstrap(edges, plain, support=3, confidence=0.8):
    """The same graph walked with dictionaries."""
    seeds = {(p, i, k): n for (p, i, k), n in edges.items() if k not in "?-"}
    unknown = {(p, i): n for (p, i, k), n in edges.items() if k == "?"}
    accepted, patterns, before = {}, {}, None
    while before != (len(patterns), len(accepted)):
        before = len(patterns), len(accepted)
        for p in {p for p, _, _ in edges}:
            total = plain.get(p, 0) + sum(n for (q, _, k), n in edges.items() if q == p and k != "?") + sum(n for (q, i), n in unknown.items() if q == p and i in accepted)
            for kind in ("email", "secret"):
                scored = {i: n for (q, i, k), n in seeds.items() if q == p and k == kind}
                mass = sum(scored.values())
                taken = {i: n for (q, i), n in unknown.items() if q == p and accepted.get(i, ("",))[0] == kind}
                mass += sum(n * accepted[i][1] for i, n in taken.items())
                if len(set(scored) | set(taken)) >= support and mass >= confidence * total:
                    patterns[p, kind] = max(patterns.get((p, kind), 0), mass / (total + 0.5))
        accepted = {}
        for i in {i for _, i in unknown}:
            doubts = {}
            for q, j in unknown:
                for kind in ("email", "secret"):
                    if j == i and (q, kind) in patterns:
                        doubts[kind] = doubts.get(kind, 1) * (1 - min(0.999, patterns[q, kind]))
            best = max(((1 - d, k) for k, d in doubts.items()), default=(0, ""))
            if best[0] >= confidence:
                accepted[i] = best[1], best[0]
    return {(p, i, accepted[i][0]) for p, i in unknown if i in accepted and (p, accepted[i][0]) in patterns}


def test_bootstrap_equals_a_plain_version(spark):
    some = 0
    for seed in range(4):
        rng = random.Random(seed)
        edges = {}
        for _ in range(160):
            p, role = rng.randrange(12), rng.choice(["email", "email", "email", "secret", "?", "?", "?", "-"])
            if role == "secret" and p < 9:
                role = "email"
            if role == "-" and p % 4:
                role = "?"
            instance = "" if role == "-" else f"{'' if role == '?' else role}{rng.randrange(14)}"
            edges[p, instance, role] = rng.randint(1, 3)
        plain = {p: rng.randrange(3) for p in range(12)}
        want = brute_bootstrap(edges, plain)
        e = spark.createDataFrame([(p, i, r, n) for (p, i, r), n in edges.items()], "pattern long, instance string, role string, n long")
        q = spark.createDataFrame(list(plain.items()), "pattern long, n long")
        assert {tuple(r) for r in pii.bootstrap(e, q).collect()} == want
        some += len(want)
    assert some


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cd here"), (None, "a@b.cd here"), (None, "plain"), (1, None)], "doc_id long, text string")
    assert sorted(r.spans for r in pii.find_pii(docs).collect()) == ["", "", "email:0:6", "email:0:6"]
    assert sorted(str(r.text) for r in pii.mask_pii(docs).collect()) == ["None", "[email] here", "[email] here", "plain"]
