"""Arrivals, updates, retirements and heartbeats as streams."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, T0, drain, feed, memory

from strandline.operators import state
from strandline.streaming import stateful

HOUR = 3_600_000


@pytest.mark.parametrize("cuts", [1, 5])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cuts):
    rng = random.Random(6)
    minutes = sorted(rng.randrange(6000) for _ in range(120))
    rows = [(rng.choice("abcd"), T0 + timedelta(minutes=m), rng.choice(["x", "y", None])) for m in minutes]
    rows.append(("end", T0 + timedelta(days=30), "x"))
    folder, step = str(tmp_path / "in"), -(-len(rows) // cuts)
    feed(spark, folder, [rows[i : i + step] for i in range(0, len(rows), step)])
    stream = stateful.event_stream(spark, folder, SCHEMA)
    drain(memory(stateful.presence_stream(stream, "6 hours", "10 minutes"), f"presence{cuts}"))
    got = spark.table(f"presence{cuts}").select("key", F.unix_millis("at").alias("at"), "kind", "n").collect()
    plain = spark.createDataFrame(rows, SCHEMA).select("key", F.unix_millis("at").alias("at"), "content", F.lit(1).alias("n"))
    want = state.presence(plain, "key", "at", "content", 6 * HOUR, HOUR // 6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.kind for r in want} == {"arrival", "update", "retirement"}


def test_late_reports_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    hour = lambda h: T0 + timedelta(hours=h)
    feed(spark, folder, [[("a", hour(2), "x")], [("a", hour(1), "late"), ("a", hour(3), "x")], [("b", hour(60), "q")], [("b", hour(61), "q")]])
    drain(memory(stateful.presence_stream(stateful.event_stream(spark, folder, SCHEMA), "24 hours", "10 minutes", "5 hours"), "late"))
    got = sorted((r.key, r.at, r.kind, r.n) for r in spark.table("late").collect())
    assert got == [("a", hour(2), "arrival", 1), ("a", hour(27), "retirement", 1), ("b", hour(60), "arrival", 1)]


def test_edge_cases_of_the_batch_form(spark):
    rows = [("a", 5, "x"), ("a", 5, "x"), ("a", 5, None), ("a", None, "x"), (None, 7, "x"), ("a", 100, "x")]
    found = state.presence(spark.createDataFrame(rows, "key string, at long, content string"), "key", "at", "content", 20, 10)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [("a", 5, "arrival", 1), ("a", 5, "update", 2), ("a", 25, "retirement", 2), ("a", 100, "arrival", 1), (None, 7, "arrival", 1), (None, 27, "retirement", 1)], key=repr)
    assert state.presence(spark.createDataFrame([], "key string, at long, content string"), "key", "at", "content", 20, 10).count() == 0


def test_an_idle_channel_beats(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [[("a", T0, "x"), ("a", T0, "y"), ("b", T0, "x")]])
    query = memory(stateful.heartbeats(stateful.event_stream(spark, folder, SCHEMA), "key", "1 second"), "beats")
    until = time.time() + 90
    while time.time() < until and spark.table("beats").where("kind = 'heartbeat' AND channel = 'a'").count() < 2:
        time.sleep(0.5)
    query.stop()
    rows = spark.table("beats").where("channel = 'a'").orderBy("sequence").collect()
    assert (rows[0].kind, rows[0].n) == ("change", 2)
    assert len(rows) >= 3 and [r.sequence for r in rows] == list(range(1, len(rows) + 1)) and {r.kind for r in rows[1:]} == {"heartbeat"}
