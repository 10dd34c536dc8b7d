"""Counts that a run keeps of itself, and rows met with their neighbours over partitions."""

import os

from pyspark.sql import functions as F

from strandline.operators import fusion
from strandline.plans.fusion import fusion_signals
from strandline.sources.parsers import with_neighbours

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_profile_counts_what_the_run_did(spark):
    prepared = fusion.prepare(fusion_signals(spark, SF))
    profile = {}
    found = fusion.true_pairs(prepared, profile).collect()
    f, keys = fusion._slim(prepared), fusion.identity_keys(prepared)
    same = keys.alias("a").join(keys.alias("b"), F.expr("a.key = b.key AND a.ord < b.ord")).select("a.ord", "b.ord")
    candidates = fusion.fuzzy_candidates(f).union(same)
    want = {"candidates": candidates.count(), "comparisons": candidates.distinct().count(), "matches": len(found)}
    assert {k: o.get["n"] for k, o in profile.items()} == want and want["matches"] > 0
    assert sorted(fusion.true_pairs(prepared).collect()) == sorted(found)


def test_neighbours_over_partitions(spark):
    values = [(i * 3, f"v{i}" if i % 4 else None) for i in range(500)]
    for n, rows in ((500, values), (1, values[:1]), (0, [])):
        frame = spark.createDataFrame(rows, "o long, v string").repartition(7)
        got = sorted((r.o, r.before, r.v, r.next) for r in with_neighbours(frame, "o", "v").collect())
        said = [None, *[v for _, v in rows], None]
        assert got == [(o, said[i], v, said[i + 2]) for i, (o, v) in enumerate(rows)] and len(got) == n
