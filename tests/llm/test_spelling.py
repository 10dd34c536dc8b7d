import random
import re
import zlib
from collections import Counter

import pytest

from strandline.llm import spelling


def count(docs):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out, forms = [], {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if v != w and near(w, v))
        forms[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
        out.append((w, forms[w], n, len(others), words[forms[w]] if forms[w] else None))
    rows = []
    for w, form, n, n_near, form_n in out:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=str)


def dictionary(seed, size, letters):
    """Words of few letters, with runs of one letter, so that many pairs are near and some in several ways."""
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        words[w] = 10 ** rng.randrange(6) * rng.randrange(1, 4)
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.randrange(1, 30))
    return words


def rows(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("most", [1, 2, 40, 512])
@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_groups_equal_brute_force(spark, most, letters):
    words = dictionary(most, 250, letters)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.spelling_groups(frame.repartition(3), most)) == brute(words)


def test_a_block_of_all_words_is_subdivided(spark):
    words = {f"commonprefix{a}{b}commonsuffix": 1 + (a == b) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    parts = spelling.blocks(frame, 20)
    assert parts.groupBy("block", "lo", "hi").count().where("hi - lo > 1").agg({"count": "max"}).first()[0] <= 20
    assert rows(spelling.spelling_groups(frame, 20)) == brute(words)


def test_chains_lead_to_the_last_form(spark):
    words = {"aaaaaaa" + "b" * i: 10**i for i in range(18)}
    got = {r.word: r for r in spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert all(r.root == "aaaaaaa" + "b" * 17 for r in got.values()) and got["aaaaaaa"].form == "aaaaaaab" and got["aaaaaaa" + "b" * 17].form is None


def test_whole_query_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Wörterbuch", "wörterbuches", "straße", "nature", "natural", "naturally", "ÀÉÎ÷×abcd", "aaaaaaaaa", "dictionary", "Dictionaries", "x" * 40]
    docs = [(i, " ".join(rng.choices(vocabulary, k=200)) + ". short 1234 naïveté") for i in range(60)]
    docs += [docs[0], docs[0], (None, "dictionary dictionarx dictionarx"), (None, None), (70, ""), (71, "dictionary" * 100_000), (72, "dictionary" * 100_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    want = count(docs)
    got = rows(spelling.spelling_variants(frame))
    assert len(want) > 20 and got == brute(want)
    assert rows(spelling.spelling_variants(frame.limit(0))) == []


def test_counts_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 2)
    docs = [(i, "dictionary dictionaries natural naturally") for i in range(50)]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == count(docs)
