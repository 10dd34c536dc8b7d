"""The continuity ledger over micro-batches: any cut of the events gives what the sequential version gives."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.commits import ReusedBatch
from strandline.plans.fusion import str01_continuity, str04_continuity_stream
from strandline.streaming import continuity as stream
from test_continuity import COLUMNS, HOUR, NAMES, SF, START, Ledger, batch

FIELDS = ("stable_id", "fused_id", "lifecycle", "first_ms", "last_ms", "changed_ms", "update_count", "change_sequence")


def frame(spark, rows, seen_ms):
    return spark.createDataFrame(rows, COLUMNS).withColumns({"seen_ms": F.lit(seen_ms), "batch": F.lit("clashing")})


def told(spark, folder):
    return {r.ord: tuple(r[c] for c in FIELDS) for r in stream.told_events(spark, folder).collect()}


def numbered(rows):
    return [(i, *r[1:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("cuts", [(0, 130), (0, 40, 41, 130)])
def test_any_cut_gives_the_sequential_result(spark, tmp_path, cuts):
    rows, folder, plain = numbered(batch(random.Random(8), 130, 60)), str(tmp_path), Ledger()
    want = plain.apply([dict(zip(NAMES, r)) for r in rows], START)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = frame(spark, rows[a:b], START)
        assert stream.continuity_step(part, n, folder, compact_every=3)
        assert not stream.continuity_step(part.orderBy(F.rand(1)), n, folder, compact_every=3)  # a batch that is run again
    assert told(spark, folder) == want
    assert stream.stored_entries(spark, folder).count() == len(plain.entries)
    with pytest.raises(ReusedBatch):
        stream.continuity_step(frame(spark, rows[:1], START + 1), 0, folder)


def test_entries_past_retention_are_forgotten(spark, tmp_path):
    rng, folder, plain, want, first = random.Random(9), str(tmp_path), Ledger(), {}, 0
    for n, now in enumerate((START, START + 20 * HOUR, START + 50 * HOUR)):
        rows = [(first + i, *r[1:]) for i, r in enumerate(batch(rng, 40, 25))]
        first += len(rows)
        want |= plain.apply([dict(zip(NAMES, r)) for r in rows], now)
        stream.continuity_step(frame(spark, rows, now), n, folder, compact_every=2)
    assert told(spark, folder) == want
    assert stream.stored_entries(spark, folder).count() == len(plain.entries)


def test_empty_batches(spark, tmp_path):
    folder = str(tmp_path)
    assert stream.told_events(spark, folder).count() == 0 and stream.stored_entries(spark, folder) is None
    empty = frame(spark, [], START)
    assert stream.continuity_step(empty, 0, folder)
    rows = numbered(batch(random.Random(1), 3, 5))
    assert stream.continuity_step(frame(spark, rows, START), 1, folder)
    assert stream.continuity_step(empty, 2, folder)
    assert stream.told_events(spark, folder).count() == 3
    assert 1 <= stream.stored_entries(spark, folder).count() <= 3


def test_the_index_brings_few_entries(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, f"e{i}", f"event{i} place{i} thing{i} word{i}", "", "cyber", ["cyber"], START, None, None, [], [], False, "1") for i in range(200)]
    stream.continuity_step(frame(spark, rows, START), 0, folder)
    state = stream._last(spark, folder)
    asked = stream._tokens(stream._features(frame(spark, rows[7:9], START).select(F.col("ord").alias("pos"), F.lit(None).cast("string").alias("stable_id"), *NAMES[1:])), True)
    met = spark.read.parquet(*state["index"]).join(asked, "token", "left_semi").select("place").distinct()
    assert met.count() == 2


def test_a_stream_goes_on_where_it_was(spark):
    want = sorted(str01_continuity(spark, SF).collect())
    assert sorted(str04_continuity_stream(spark, SF).collect()) == want
