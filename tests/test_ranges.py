"""Neighbouring rows: ranges grow in number, not in size."""

from strandline.sources import parsers


def test_ranges_have_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(parsers, "RANGE_ROWS", 10)
    seen, cut = [], parsers.cut
    monkeypatch.setattr(parsers, "cut", lambda frame: seen.append(cut(frame)) or seen[-1])
    got = sorted((r.o, r.before, r.next) for r in parsers.with_neighbours(spark.range(200).selectExpr("id AS o", "id AS v"), "o", "v").collect())
    assert got == [(i, i - 1 if i else None, i + 1 if i < 199 else None) for i in range(200)]
    assert seen[0].groupBy("_pid").count().agg({"count": "max"}).first()[0] <= 20
