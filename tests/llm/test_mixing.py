import numpy as np
from pyspark.sql import functions as F

from strandline.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def documents(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}" if i % 50 else "tiny"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), source))
    return spark.createDataFrame(rows + [(None, None, "s1"), (5, "a b", None), (5, "a b", None), (9, "", "void")], "doc_id long, text string, source string")


def test_targets_sizes_and_takes(spark, monkeypatch):
    docs = documents(spark, 1500).withColumn("size", F.lit("clash")).withColumn("p", F.lit(0))
    base = [(r.doc_id, len((r.text or "").split()), r.source) for r in docs.collect()]
    sizes = {}
    for _, n, s in base:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    runs = []
    monkeypatch.setattr(mixing.cube_sample, "__defaults__", (mixing.SEED, 64))
    for frame in (docs, docs.orderBy(F.desc("doc_id")).repartition(5)):
        got = mixing.mix(frame).collect()
        assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(a), b, str(c)) for a, b, c in base)
        runs.append(sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in got))
        taken = {}
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
            assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= 60, (s, taken[s], t)
    assert runs[0] == runs[1]
    assert mixing.mix(docs.where("false")).count() == 0


def test_flight_keeps_totals_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 300).astype(float)
    p = rng.random(300) * 0.98 + 0.01
    mean = np.zeros(300)
    for k in range(200):
        q = mixing.flight(p, size, np.random.default_rng(k))
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        mean += q / 200
    assert np.abs(mean - p).mean() < 0.05


def test_copies_of_one_row_are_spread(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s")], "doc_id long, text string, source string").crossJoin(spark.range(100_000).select()).unionByName(
        spark.createDataFrame([(2, "e " * 40, "t"), (None, "x y", None), (None, "x y", None)], "doc_id long, text string, source string")
    )
    got = mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    rows = {r.doc_id: r for r in got}
    assert {k: r.n for k, r in rows.items()} == {1: 100_000, 2: 1, None: 2}
    assert abs(rows[1].taken - rows[1].target) <= 4
    numbered = mixing._numbered(docs.select("doc_id", "source"))
    buckets = numbered.groupBy(F.pmod(F.xxhash64(*numbered.columns), F.lit(25))).count().collect()
    assert max(r["count"] for r in buckets) < 5000 and numbered.distinct().count() == 100_003
