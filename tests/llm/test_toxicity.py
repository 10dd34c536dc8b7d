import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        grade = rng.choices([0, 1, 2], [7, 2, 1])[0]
        text = rng.choices(words, k=rng.randint(5, 120)) + rng.choices(["rude", "vile"], k=grade and 2) + ["foul"] * (grade == 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), grade))
    return rows


def test_held_out_grades(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (None, "rude vile")], "doc_id long, text string").withColumn("grade", F.lit("clash"))
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i < 900] + [(5, None), (None, 2)], "doc_id long, grade int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, grades, toxic_grade=1).collect()}
    assert len(got) == len(rows) + 3
    held = [(got[i], g) for i, _, g in rows if i >= 900]
    assert np.mean([r.toxic == (g > 0) for r, g in held]) > 0.95
    means = [np.mean([r.expected_severity for r, g in held if g == k]) for k in range(3)]
    assert means[0] < 0.3 < means[1] < means[2]
    assert not got[9000].toxic and not got[9001].toxic and got[None].toxic
    assert toxicity.toxicity(docs, grades.where("false"), toxic_grade=1).where("toxic").count() == 0
    assert toxicity.toxicity(docs.where("false"), grades).count() == 0


def test_probabilities_are_ordered_and_sum_to_one():
    model = toxicity.fit([np.array([1, 2]), np.array([3]), np.array([3, 4])] * 5, np.array([0, 1, 2] * 5), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    for at in ([1], [3], [3, 4], []):
        p = model.probabilities(np.array(at, int))
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()


def dense_refit(x, grades, n_grades, rounds=6000):
    """The same likelihood with a dense matrix, by plain gradient descent; it is convex, so the optimum is one."""
    w, t = np.zeros(x.shape[1]), np.linspace(0, 1, n_grades - 1)
    for _ in range(rounds):
        s = x @ w
        edges = np.column_stack([np.full(len(s), -np.inf), *[c - s for c in t], np.full(len(s), np.inf)])
        cdf = 1 / (1 + np.exp(-edges))
        up, low = cdf[np.arange(len(s)), grades + 1], cdf[np.arange(len(s)), grades]
        d_up, d_low = up * (1 - up), low * (1 - low)
        p = up - low
        g_s = (d_up - d_low) / p / len(s)
        g_t = [(-(d_up / p)[grades == k].sum() + (d_low / p)[grades == k + 1].sum()) / len(s) for k in range(n_grades - 1)]
        w = w - 2.0 * (x.T @ g_s + toxicity.SHRINK * w)
        t = t - 2.0 * np.array(g_t)
    return w, t


def test_fit_equals_a_dense_version():
    rows = corpus(700, 4)
    hashes = toxicity.WordHashes()
    found = [toxicity.features(text, hashes) for _, text, _ in rows]
    rng = random.Random(7)  # some wrong labels, so that the likelihood has its optimum at weights of common size
    grades = np.array([rng.randrange(3) if rng.random() < 0.2 else g for _, _, g in rows])
    model = toxicity.fit(found, grades, 3)
    chosen = np.flatnonzero(model.weights)
    told = {w: int(hashes.of([w.encode()])[0]) & ((1 << toxicity.BITS) - 1) for w in ("rude", "vile", "foul")}
    assert set(told.values()) <= set(chosen.tolist()) and len(chosen) < 60
    x = np.array([np.isin(chosen, f) for f in found], float)
    w, t = dense_refit(x, grades, 3)
    s = x @ w
    dense = np.diff(np.column_stack([np.zeros(len(s)), *[1 / (1 + np.exp(-(c - s))) for c in t], np.ones(len(s))]))
    sparse = np.array([model.probabilities(f) for f in found])
    assert np.abs(dense - sparse).max() < 0.03 and (dense.argmax(1) == sparse.argmax(1)).mean() > 0.99


def test_repeated_rows_and_ids(spark):
    rows = [r[:2] for r in corpus(60, 2)]
    docs = spark.createDataFrame(rows + [rows[0]] * 500 + [(1, None), (1, "other text")], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 3) for i in range(60)] * 2, "doc_id long, grade int")
    once = spark.createDataFrame([r for r in rows if r[0] != 1] + [(1, min(rows[1][1], "other text"))], "doc_id long, text string")
    a, b = toxicity.fit_on(docs, grades, 3), toxicity.fit_on(once, grades, 3)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)
    assert toxicity.toxicity(docs, grades).count() == len(rows) + 502
