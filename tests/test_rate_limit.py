"""The rate limit against its rule, request by request."""

import os
import random

from strandline.operators import state
from strandline.plans import registry
from strandline.sources.adapters import signals

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, most, span):
    windows, allowed = {}, {}
    for key, at, order in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in windows or at > windows[key][1]:
            windows[key] = [0, at + span]
        windows[key][0] += 1
        allowed[order] = windows[key][0] <= most
    return allowed


def test_windows_begin_with_a_first_request(spark):
    rows = [("a", 59, 1), ("a", 61, 2), ("a", 62, 3), ("a", 119, 4), ("a", 120, 5), ("b", 60, 6)]
    got = state.rate_limit(spark.createDataFrame(rows, "key string, at long, n long"), "key", "at", "n", 2, 60)
    assert {r.n: r.allowed for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_rate_limit_equals_brute_force_in_small_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), rng.randrange(4000), i) for i in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = state.rate_limit(spark.createDataFrame(rows, "key string, at long, n long"), "key", "at", "n", 3, 60).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and {r.n: r.allowed for r in got} == brute(rows, 3, 60)


def test_query_equals_brute_force(spark):
    rows = [(r.source, r.occurred_ms, r.ord) for r in signals(spark, SF).select("source", "occurred_ms", "ord").collect()]
    assert {r.ord: r.allowed for r in registry.QUERIES["str12_rate_limit"](spark, SF).collect()} == brute(rows, 2, 3_600_000)
