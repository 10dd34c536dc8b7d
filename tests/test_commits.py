"""The transaction log: replay, reuse, stale revisions, identities, racing writers."""

import threading

import pytest

from strandline.operators import commits


def writes(spark, *rows):
    return spark.createDataFrame([(list(i), p, r) for i, p, r in rows], "identities array<string>, payload string, expected_revision long")


def told(frame):
    return {r.identity: (r.revision, r.cursor, r.changed) for r in frame.collect()}


def test_revisions_cursors_replay_and_conflicts(spark, tmp_path):
    folder = f"file:{tmp_path}/log"
    first = writes(spark, (["b", "b2"], "one", None), (["a"], "one", None), (["c"], None, None))
    got = commits.commit(spark, folder, "batch-1", first)
    assert told(got) == {"a": (1, 1, True), "b": (1, 2, True), "c": (1, 3, True)}
    # The same input in another order returns the same; other input with the id fails.
    assert told(commits.commit(spark, folder, "batch-1", first.orderBy("payload").repartition(3))) == told(got)
    with pytest.raises(commits.ReusedBatch):
        commits.commit(spark, folder, "batch-1", writes(spark, (["a"], "two", 1)))
    # A stale revision takes the whole batch with it.
    with pytest.raises(commits.RevisionConflict):
        commits.commit(spark, folder, "batch-2", writes(spark, (["a"], "two", 1), (["b"], "two", None)))
    with pytest.raises(commits.RevisionConflict):
        commits.commit(spark, folder, "batch-2", writes(spark, (["d"], "new", 1)))
    assert len(commits.versions(spark, folder)) == 1
    # An equal payload changes nothing, whatever it expects; a new identity joins its event.
    got = commits.commit(spark, folder, "batch-2", writes(spark, (["a"], "one", 9), (["b2", "x"], "two", 1), (["d"], "new", None)))
    assert told(got) == {"a": (1, 1, False), "b2": (2, 4, True), "d": (1, 5, True)}
    ids = {r.identity: r.event_id for r in got.collect()}
    got = commits.commit(spark, folder, "batch-3", writes(spark, (["x"], "three", 2)))
    assert got.first().event_id == ids["b2"] and told(got) == {"x": (3, 6, True)}
    with pytest.raises(commits.IdentityConflict):
        commits.commit(spark, folder, "batch-4", writes(spark, (["a", "x"], "joined", 1)))
    with pytest.raises(commits.IdentityConflict):
        commits.commit(spark, folder, "batch-4", writes(spark, (["q"], "1", None), (["q"], "2", None)))
    with pytest.raises(commits.IdentityConflict):
        commits.commit(spark, folder, "batch-4", writes(spark, ([], "1", None)))
    assert told(commits.commit(spark, folder, "batch-5", writes(spark, (["a"], "x", 1)).limit(0))) == {}
    now = {r.event_id: (r.revision, r.payload) for r in commits.current_events(spark, folder).collect()}
    assert len(now) == 4 and now[ids["b2"]] == (3, "three")
    assert {r.revision for r in commits.current_events(spark, folder, 1).collect()} == {1}
    assert sorted(r.cursor for r in commits.changes_after(spark, folder, 3).collect()) == [4, 5, 6]


def test_of_racing_writers_one_wins(spark, tmp_path):
    folder, won, lost = f"file:{tmp_path}/log", [], []

    def write(k):
        try:
            won.append((k, told(commits.commit(spark, folder, f"batch-{k}", writes(spark, (["a"], f"by {k}", None))))))
        except commits.RevisionConflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 2 and won[0][1] == {"a": (1, 1, True)}
    assert [r.payload for r in commits.current_events(spark, folder).collect()] == [f"by {won[0][0]}"] and len(commits.versions(spark, folder)) == 1
