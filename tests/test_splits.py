"""Reviewed splits: exact coverage or nothing, one version, replays and conflicts."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import commits, splits

PLAN = "parent_id string, parent_revision long, child long, identities array<string>, payload string"


@pytest.fixture()
def store(spark, tmp_path):
    folder = str(tmp_path)
    writes = [(["a", "b", "c"], "first", None), (["d", "e"], "second", None), (["f"], "third", None)]
    commits.commit(spark, folder, "one", spark.createDataFrame(writes, "identities array<string>, payload string, expected_revision long"))
    return folder


def owners(spark, folder):
    return {r.identity: r.event_id for r in commits.current_identities(spark, folder).collect()}


def plan(spark, rows):
    return spark.createDataFrame(rows, PLAN).withColumn("cursor", F.lit("clashing"))


def test_a_split_moves_all_or_nothing(spark, store):
    own = owners(spark, store)
    p, q = own["a"], own["d"]
    good = plan(spark, [(p, 1, 2, ["c"], "third part"), (p, 1, 1, ["b", "a"], "main part"), (q, 1, 1, ["d"], "d"), (q, 1, 2, ["e"], "e")])
    assert [r.blockers for r in splits.preflight(spark, store, good).collect()] == [[], []]
    with pytest.raises(splits.SplitConflict):
        splits.apply_splits(spark, store, "op", good, 2)
    rows = splits.apply_splits(spark, store, "op", good, 3).collect()
    assert sorted(r.cursor for r in rows) == [4, 5, 6, 7, 8, 9]
    of = {(r.parent_id, r.child): r for r in rows}
    assert of[p, None].revision == 2 and of[p, 1].cursor < of[p, 2].cursor < of[p, None].cursor
    now = {r.event_id: r for r in commits.current_events(spark, store).collect()}
    assert now[p].replaced_by == [of[p, 1].event_id, of[p, 2].event_id] and now[p].payload == "first"
    assert now[of[p, 2].event_id].payload == "third part" and now[own["f"]].replaced_by is None
    moved = owners(spark, store)
    assert moved["a"] == moved["b"] == of[p, 1].event_id and moved["c"] == of[p, 2].event_id and moved["f"] == own["f"]
    # The old revisions stay, a replay gives the same, another plan of that name and a second split are refused.
    assert commits.changes_after(spark, store, 0).where(F.col("event_id") == p).count() == 2
    assert splits.apply_splits(spark, store, "op", good, 3).orderBy("cursor").collect() == sorted(rows, key=lambda r: r.cursor)
    with pytest.raises(commits.ReusedBatch):
        splits.apply_splits(spark, store, "op", good.limit(1), 3)
    assert {tuple(r.blockers) for r in splits.preflight(spark, store, good).collect()} == {("identities_changed", "parent_changed", "parent_replaced")}
    # Later writes reach the child.
    again = commits.commit(spark, store, "two", spark.createDataFrame([(["c"], "newer", 1)], "identities array<string>, payload string, expected_revision long")).first()
    assert (again.event_id, again.revision, again.cursor) == (of[p, 2].event_id, 2, 10)


@pytest.mark.parametrize(("rows", "blocker"), [
    ([("P", 1, 1, ["a"], "x"), ("P", 1, 2, ["b"], "y")], "incomplete_partitions"),
    ([("P", 1, 1, ["a", "b"], "x"), ("P", 1, 2, ["b", "c"], "y")], "overlapping_partitions"),
    ([("P", 1, 1, ["a", "b"], "x"), ("P", 1, 2, ["c", "d"], "y")], "identities_changed"),
    ([("P", 1, 1, ["a", "b", "c"], "x")], "invalid_split_size"),
    ([("P", 1, 1, ["a", "b", "c"], "x"), ("P", 1, 2, ["", None], "y")], "child_without_identity"),
    ([("P", 1, 1, ["a", "b"], " "), ("P", 1, 2, ["c"], None)], "child_payload_missing"),
    ([("P", 1, 1, ["a", "b"], "x"), ("P", 2, 2, ["c"], "y")], "inconsistent_revision"),
    ([("P", 7, 1, ["a", "b"], "x"), ("P", 7, 2, ["c"], "y")], "parent_changed"),
    ([(None, 1, 1, ["a", "b"], "x"), (None, 1, 2, ["c"], "y")], "parent_missing"),
])
def test_blockers(spark, store, rows, blocker):
    own = owners(spark, store)
    p = plan(spark, [(own["a"] if r[0] == "P" else r[0], *r[1:]) for r in rows])
    assert blocker in splits.preflight(spark, store, p).first().blockers
    with pytest.raises(splits.SplitConflict):
        splits.apply_splits(spark, store, "op", p, 3)
    assert owners(spark, store) == own and len(commits.versions(spark, store)) == 1


def test_observations_and_empty_plans(spark, store):
    p = owners(spark, store)["a"]
    good = plan(spark, [(p, 1, 1, ["a", "b"], "x"), (p, 1, 2, ["c"], "y")])
    seen = lambda *rows: spark.createDataFrame(rows, "identity string, observed_ms long")
    check = lambda s: splits.preflight(spark, store, good, s, 100).first().blockers
    assert check(seen(("b", 5), ("c", 100))) == []
    assert check(seen(("b", 5))) == ["source_observation_missing"]
    assert check(seen(("a", 101), ("c", 0))) == ["source_observation_time_invalid"]
    empty = plan(spark, [])
    assert splits.preflight(spark, store, empty).count() == 0
    assert splits.apply_splits(spark, store, "none", empty, 3).count() == 0
