"""Steps whose work must not grow faster than what they are asked for."""

import os
import random
from math import asin, cos, radians, sin, sqrt

from strandline.operators import fusion, reconcile
from strandline.plans import feed, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_nation_are_spread_over_tasks(spark):
    for name in ("sca01_haversine", "sca02_bearing_destination", "sca11_format_distance"):
        sizes = registry.QUERIES[name](spark, SF).rdd.glom().map(len).collect()
        assert len(sizes) == feed.PAIR_TASKS and max(sizes) < sum(sizes) / 10


def test_parts_are_ranked_before_they_meet_customers(spark):
    said = plan(registry.QUERIES["set09_match_edges"](spark, SF))
    assert 0 <= said.index("Join") < said.index("Window")


def test_pairs_of_single_observations_are_not_shuffled(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["earthquake", "wildfire", "storm"]), rng.randrange(1, 200_000_000), rng.uniform(-0.5, 0.5), rng.choice([-179.9, 179.9, 0.0]) + rng.uniform(0, 0.09)) for i in range(300)]
    want = {}
    for m in (rows, rows + [(i, c, at + 1000, lat, lng) for i, c, at, lat, lng in rows[:40]]):
        frame = spark.createDataFrame(m, "member long, category string, at_ms long, lat double, lng double")
        found = reconcile.nearby_members(frame)
        got = {(r.left, r.right): (round(r.km, 6), r.seconds) for r in found.collect()}
        assert len(got) == found.count()
        want = {}
        for i, c, at, lat, lng in m:
            for j, d, then, there, far in m:
                apart = abs(at - then)
                if i < j and c == d and apart <= {"earthquake": 900_000, "wildfire": 86_400_000}.get(c, -1):
                    h = sin(radians(there - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(there)) * sin(radians(far - lng) / 2) ** 2
                    km = 2 * 6371 * asin(min(1.0, sqrt(h)))
                    if km <= 25:
                        want[i, j] = min(want.get((i, j), (9e9, 0)), (round(km, 6), apart / 1000))
        assert got == want and want
        assert ("Aggregate(key=[left" in plan(found).replace("keys", "key")) == (len(m) > len(rows))


def test_titles_are_compared_once_a_list_of_words(spark):
    rng = random.Random(5)
    words = [f"w{i:02}" for i in range(12)]
    rows = [(i, rng.choice(["s", "t", None]), sorted(rng.sample(words, rng.randrange(1, 6)))) for i in range(150)]
    rows += [(150 + i, "s", rows[i % 4][2]) for i in range(20)]
    found = fusion.alike_titles(spark.createDataFrame(rows, "doc_id long, source string, w array<string>"), 0.5)
    got = sorted((r.a, r.b, r.similarity) for r in found.collect())
    share = lambda x, y: len(set(x) & set(y)) / max(len(x), len(y))
    assert got == sorted((a, b, share(x, y)) for a, s, x in rows for b, t, y in rows if a < b and s == t and s and share(x, y) >= 0.5)


def test_reports_of_one_time_and_place_meet_as_one(spark):
    rows = [(i, "wildfire", 5_000_000 + i % 2 * 1000, 0.01 * (i % 3), 179.99 + i % 2 * 0.005) for i in range(60)] + [(7, "wildfire", 5_000_500, 0.0, 179.99), (7, "wildfire", 5_000_500, 0.0, 179.99)]
    found = reconcile.nearby_members(spark.createDataFrame(rows, "member long, category string, at_ms long, lat double, lng double"))
    got = [(r.left, r.right) for r in found.collect()]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
    said = plan(found)
    assert said.index("Generate explode(one") < said.index("SortMergeJoin")


def test_places_of_a_nation_meet_once_for_all_their_keys(spark, tmp_path):
    spark.range(60).selectExpr("id % 3 * 36000 + id AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(700).selectExpr("id * 36000 AS c_custkey", "id % 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    met = feed._pairs(spark, str(tmp_path))
    assert met.selectExpr("sum(size(s_suppkey) * size(c_custkey))").first()[0] == 60 * 350 and met.count() == 60 * 2
    for name in ("sca01_haversine", "sca02_bearing_destination", "sca11_format_distance"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        assert found.distinct().count() == found.count() == 60 * 350
        assert plan(found).index("Generate explode(c_custkey") < plan(found).index("SortMergeJoin")
