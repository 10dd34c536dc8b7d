"""Pages, cursors and resets of a client of the transaction log."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import commits, replay

WRITES = "identities array<string>, payload string, expected_revision long"


def commit(spark, folder, batch, rows):
    return commits.commit(spark, folder, batch, spark.createDataFrame(rows, WRITES))


def told(frame):
    return sorted((r.event_id, r.revision, r.cursor, r.payload) for r in frame.collect())


def test_pages_and_resets(spark, tmp_path):
    folder, other = str(tmp_path / "a"), str(tmp_path / "b")
    assert told(replay.bootstrap(spark, folder)[0]) == [] and told(replay.changes(spark, folder).changes) == []
    commit(spark, folder, "one", [([f"i{n}"], f"p{n}", None) for n in range(5)])
    have, token = replay.bootstrap(spark, folder)
    have = have.cache()
    assert have.count() == 5
    commit(spark, folder, "two", [([f"i{n}"], f"q{n}", 1) for n in range(3)] + [(["new"], "n", None)])
    # Pages of three from the beginning; what is committed between them waits for the next replay.
    cursors, at, page = [], None, None
    for n in range(9):
        page = replay.changes(spark, folder, at, 3)
        cursors += [r.cursor for r in page.changes.collect()]
        at = page.token
        if n == 0:
            commit(spark, folder, "three", [(["late"], "l", None)])
        if not page.has_more:
            break
    assert cursors == list(range(1, 10)) and page.through == 9
    assert [r.payload for r in replay.changes(spark, folder, at).changes.collect()] == ["l"]
    now, after, how = replay.synchronise(spark, folder, have.withColumn("other", F.lit(1)), token)
    assert how == "changes" and told(now) == told(commits.current_events(spark, folder))
    again, same, how = replay.synchronise(spark, folder, now, after)
    assert (same, how) == (after, "changes") and told(again) == told(now)
    # Resets: no token, one that can't be read, another store's, one before the floor or beyond the log.
    commit(spark, other, "one", [(["i0"], "p", None)])
    assert replay.keep_after(spark, folder, 6) == 6 and replay.keep_after(spark, folder, 2) == 6
    beyond = replay._encode(replay._epoch(commits.versions(spark, folder)), 99, None)
    for bad in ("?", "x" * 600, replay._encode("e", 1, True), replay.bootstrap(spark, other)[1], token, beyond):
        with pytest.raises(replay.CursorResetRequired):
            replay.changes(spark, folder, bad)
        assert replay.synchronise(spark, folder, have, bad)[2] == "bootstrap"
    assert told(replay.synchronise(spark, folder, None, None)[0]) == told(now)
    assert replay.keep_after(spark, folder, 1000) == 10


def test_a_client_far_behind_begins_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "PAGES", 0)
    commit(spark, str(tmp_path), "one", [(["a"], "p", None)])
    have, token = replay.bootstrap(spark, str(tmp_path))
    commit(spark, str(tmp_path), "two", [(["b"], "p", None)])
    now, _, how = replay.synchronise(spark, str(tmp_path), have, token)
    assert how == "bootstrap" and now.count() == 2
