"""Operators that SQL can't say, and edge cases of those it can."""

from pyspark.sql import functions as F

from strandline.operators import intel, reconcile, spatial, state, tracks
from strandline.functions import geo


def test_polyline_against_known_points(spark):
    assert reconcile.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert reconcile.decode_polyline(None) == [] and reconcile.decode_polyline("_p~iF") == []
    row = spark.range(1).select(reconcile.polyline_points(F.lit("_p~iF~ps|U")).alias("p")).first()
    assert row.p[0].lng == -120.2


def test_radius_join_is_complete_near_poles_and_the_date_line(spark):
    points = [(i, -89.9 + (i * 37 % 1798) / 10, -180 + (i * 101 % 3600) / 10) for i in range(600)] + [(700, 89.95, 10.0), (701, 0.0, 179.99), (702, 0.0, -179.99)]
    centres = [(i, -89.5 + i * 8.9, -179.9 + (i * 17 % 360)) for i in range(20)] + [(50, 89.9, -170.0), (51, 0.0, -179.95)]
    p = spark.createDataFrame(points, "id long, lat double, lng double")
    c = spark.createDataFrame(centres, "cid long, c_lat double, c_lng double")
    got = {(r.id, r.cid) for r in spatial.radius_join(p, c, 300.0).collect()}
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    want = {(r.id, r.cid) for r in p.crossJoin(c).where(km <= 300).collect()}
    assert got == want and (702, 51) in got and (701, 51) in got and (700, 50) in got


def test_lengths_and_areas(spark):
    r = spark.range(1)
    cell = geo.rect_ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    assert abs(r.select(geo.ring_area_km2(cell).alias("a")).first().a - 12363.7) < 1
    circle = geo.circle_ring(F.lit(50.0), F.lit(10.0), F.lit(100.0))
    area = r.select(geo.ring_area_km2(circle).alias("a")).first().a
    assert abs(area / (3.14159265 * 100**2) - 1) < 0.003
    q = r.select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("q"), geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("n")).first()
    assert abs(q.q - 10007.5) < 1 and q.n is None


def test_current_leg_cases(spark):
    def leg(grounds):
        t = spark.createDataFrame([("c", i, g) for i, g in enumerate(grounds)], "craft string, ord int, on_ground boolean")
        return sorted(r.ord for r in tracks.current_leg(t, "craft", "ord").collect())

    g, a = True, False
    assert leg([a, a, g, g, g, g, a, a, a]) == [6, 7, 8]
    assert leg([a, a, g, g, a, a]) == [0, 1, 2, 3, 4, 5]
    assert leg([g, g, g]) == [1, 2]
    assert leg([a, g, g, g, g, a, a, g]) == [5, 6]
    assert leg([g, g, g, g, a]) == [0, 1, 2, 3, 4]


def test_ledger_keeps_identities_over_many_batches(spark):
    rows = [("a", b, "x" if b < 10 else "y") for b in range(30)] + [("b", b, "z") for b in (0, 1, 9)]
    got = {(r.key, r.batch): r for r in state.ledger(spark.createDataFrame(rows, "key string, batch long, content string"), "key", "batch", "content", 3).collect()}
    assert got["a", 0].lifecycle == "new" and got["a", 10].lifecycle == "updated" and got["a", 29].update_count == 1 and got["a", 29].first_seen == 0
    assert got["b", 9].lifecycle == "new" and got["b", 9].first_seen == 9 and got["a", 29].change_sequence == got["a", 10].change_sequence
    changes = sorted(r.change_sequence for r in got.values() if r.lifecycle != "ongoing")
    assert changes == list(range(1, len(changes) + 1))


def test_certificate_names_with_nulls_repeats_and_a_limit(spark):
    rows = [(i, "x.org", "c", i % 2, f"*.a{i}.x.org\n x.org ") for i in range(6)] + [(9, "x.org", None, None, None), (9, "x.org", None, None, None)]
    rows += [(1, None, "c", 1, "a.x.org"), (1, "y.org", "c", 1, "")]
    certs = spark.createDataFrame(rows, "n long, domain string, cn string, serial long, names string")
    got = {r.domain: tuple(r)[1:] for r in intel.certificate_names(certs, ["n"]).collect()}
    assert got == {"x.org": (8, 3, "a0.x.org,a1.x.org,x.org"), None: (1, 1, ""), "y.org": (1, 1, "")}
    assert {r.domain: r.subdomains for r in intel.certificate_names(certs, ["n"], 1).collect()}["x.org"] == "a0.x.org,x.org"
    assert intel.certificate_names(certs.limit(0), ["n"]).count() == 0


def test_quote_changes_fall_back_and_pass_over_gaps(spark):
    closes = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 20.0), ("b", 1, 5.0), ("c", 1, 0.0), ("c", 2, float("nan")), ("c", 3, 1.0), ("x", 1, 1.0)], "q string, n long, close double")
    quotes = spark.createDataFrame([("a", 12.0, 99.0), ("b", 12.0, 8.0), ("c", 12.0, 8.0), ("d", 12.0, None)], "q string, price double, fallback double")
    got = {r.q: (r.previous, r.change_pct) for r in tracks.quote_changes(closes, quotes, "q", "n").collect()}
    assert got == {"a": (10.0, 20.0), "b": (8.0, 50.0), "c": (0.0, None), "d": (None, None)}
    assert tracks.quote_changes(closes, quotes.limit(0), "q", "n").count() == 0
