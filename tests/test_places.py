"""Merged places of a request against a plain fold, with nulls and ties."""

import random

from strandline.operators import reconcile


def test_merged_places_equal_the_fold(spark):
    rng, rows = random.Random(9), []
    for request in [*range(25), None]:
        for rank in range(rng.randrange(16)):
            rows.append((request, rng.random() < 0.5, rank // 2, rng.choice([None, 0.2, 0.5, 0.9]), rng.choice([None, "Paris", "PARIS", "Lyon", ""]), rng.choice([None, 1.0, 1.0004, 2.0]), rng.choice([3.0, 3.0009, 3.002])))
    want = []
    for request in {r[0] for r in rows}:
        prominent = lambda r: r[1] and (r[3] or 0) >= 0.5
        order = lambda r: (0 if prominent(r) else 2 if r[1] else 1, -r[3] if prominent(r) else 0, r[2], r[4] or "", r[5], r[6])
        kept = []
        for r in sorted((r for r in rows if r[0] == request and r[5] is not None), key=order):
            if not any((k[4] or "").lower() == (r[4] or "").lower() and abs(k[5] - r[5]) < 0.001 and abs(k[6] - r[6]) < 0.001 for k in kept):
                kept.append(r)
        want += [(request, i, r[4] or "", r[5], r[6]) for i, r in enumerate(kept[:8])]
    frame = spark.createDataFrame(rows, "request long, secondary boolean, rank int, score double, name string, lat double, lng double")
    assert sorted(map(tuple, reconcile.merged_places(frame.repartition(3)).collect()), key=str) == sorted(want, key=str)
    assert reconcile.merged_places(frame.limit(0)).collect() == []
