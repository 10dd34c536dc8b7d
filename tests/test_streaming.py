from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandline.streaming import stateful

SCHEMA = "key string, at timestamp, content string"
T0 = datetime(2024, 1, 1)


def feed(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(query):
    query.processAllAvailable()
    query.stop()


def memory(frame, name, mode="append"):
    return frame.writeStream.format("memory").queryName(name).outputMode(mode).start()


def test_ledger_and_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    hour = lambda h, **m: T0 + timedelta(hours=h, **m)
    feed(spark, folder, [[("a", hour(0), "x"), ("b", hour(0), "x")], [("a", hour(1), "x"), ("b", hour(1), "y")], [("a", hour(2), "z"), ("c", hour(2), "q")]])
    stream = stateful.event_stream(spark, folder, SCHEMA)
    drain(memory(stateful.ledger_stream(stream), "ledger"))
    got = {(r.key, r.at): (r.lifecycle, r.update_count) for r in spark.table("ledger").collect()}
    assert sorted(v for (k, _), v in got.items() if k == "a")[0] == ("new", 0) and len(got) == 6
    assert sum(v[0] == "new" for v in got.values()) == 3
    drain(memory(stateful.windowed_counts(stream, "at", "key", "6 hours"), "counts", "complete"))
    assert {(r.key, r.n) for r in spark.table("counts").collect()} == {("a", 3), ("b", 2), ("c", 1)}
    drain(memory(stateful.first_reports(stream, "at", ["key"]), "firsts"))
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["a", "b", "c"]


def test_commits_replace_themselves(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    feed(spark, folder, [[("a", T0, "1"), ("a", T0 + timedelta(hours=1), "2")], [("a", T0 + timedelta(hours=2), "3"), ("b", T0, "1")]])
    for n in range(2):  # a lost checkpoint runs all batches again
        stateful.commit_batches(stateful.event_stream(spark, folder, SCHEMA), table, str(tmp_path / f"check{n}"), ["key"], "at").awaitTermination()
    rows = spark.read.parquet(table)
    assert rows.count() == 3 and {r.content for r in rows.where(F.col("key") == "a").collect()} == {"2", "3"}
