"""Reviewed splits of stored events: a package for review, its check against the store, and its atomic application.

A plan has a row a child: ``parent_id, parent_revision, child`` (a number, unique in its parent), ``identities`` (array),
``payload``.  The store is a transaction log (``strandline.operators.commits``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.operators.commits import CHANGES, IDENTITIES, ReusedBatch, _all, _fs, _latest, _numbered, _owners, _published, input_hash, versions
from strandline.session import cut

LEAST, MOST = 2, 100
APPLIED = "parent_id string, child bigint, event_id string, revision bigint, cursor bigint"


class SplitConflict(ValueError):
    """A split that doesn't fit the store as it is, or isn't a partition of its parent's identities."""


def _given(plan: DataFrame) -> DataFrame:
    named = F.array_sort(F.filter("identities", lambda x: F.length(x) > 0))
    return plan.select("parent_id", F.col("parent_revision").cast("long").alias("parent_revision"), F.col("child").cast("long").alias("child"), F.coalesce(named, F.array().cast("array<string>")).alias("identities"), F.col("payload").cast("string").alias("payload"))


def _shape(given: DataFrame) -> DataFrame:
    """``parent_id, own`` (blockers that the plan alone shows, sorted), ``parent_revision, children``."""
    named = given.select("parent_id", F.explode("identities").alias("identity")).groupBy("parent_id", "identity").count()
    shared = named.groupBy("parent_id").agg(F.bool_or(F.col("count") > 1).alias("shared"))
    g = given.groupBy("parent_id").agg(
        F.count("*").alias("children"), F.count_distinct("child").alias("numbers"), F.bool_or(F.size("identities") == 0).alias("bare"), F.bool_or(F.col("payload").isNull() | (F.trim("payload") == "")).alias("blank"),
        F.min("parent_revision").alias("parent_revision"), F.max("parent_revision").alias("top"), F.count("parent_revision").alias("told"),
    ).join(shared, "parent_id", "left")
    size = ~F.col("children").between(LEAST, MOST) | (F.col("numbers") < F.col("children"))
    found = F.array(
        F.when(F.col("blank"), "child_payload_missing"), F.when(F.col("bare"), "child_without_identity"), F.when(size, "invalid_split_size"),
        F.when((F.col("parent_revision") != F.col("top")) | (F.col("told") < F.col("children")), "inconsistent_revision"), F.when(F.coalesce("shared", F.lit(False)), "overlapping_partitions"),
    )
    return g.select("parent_id", "parent_revision", "children", F.array_compact(found).alias("own"))


def _against(given: DataFrame, events: DataFrame, identities: DataFrame) -> DataFrame:
    """``parent_id, children, blockers``: sorted; an empty array says that the split may be applied."""
    shape = _shape(given)
    parents = events.select(F.col("event_id").alias("parent_id"), "revision", F.size(F.coalesce("replaced_by", F.array().cast("array<string>"))).alias("replaced"))
    asked = given.select("parent_id", F.explode("identities").alias("identity")).distinct().withColumn("asked", F.lit(True))
    wanted = shape.select("parent_id")
    held = identities.select(F.col("event_id").alias("parent_id"), "identity").join(wanted, "parent_id", "left_semi").withColumn("held", F.lit(True))
    uncovered = asked.join(held, ["parent_id", "identity"], "full").groupBy("parent_id").agg(F.bool_or(F.col("asked").isNull()).alias("missed"), F.bool_or(F.col("held").isNull()).alias("foreign"))
    j = shape.join(parents, "parent_id", "left").join(uncovered, "parent_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    found = F.concat("own", F.array_compact(F.array(
        F.when(no(F.col("missed")), "incomplete_partitions"), F.when(no(F.col("foreign")), "identities_changed"), F.when(F.col("revision").isNull(), "parent_missing"),
        F.when(F.col("revision") != F.col("parent_revision"), "parent_changed"), F.when(no(F.col("replaced") > 0), "parent_replaced"),
    )))
    return j.select("parent_id", "children", F.array_sort(found).alias("blockers"))


def preflight(spark: SparkSession, folder: str, plan: DataFrame, observed: DataFrame | None = None, now_ms: int | None = None) -> DataFrame:
    """``parent_id, children, blockers`` of each split against the store as it is; nothing is changed.

    Blockers of the plan: child_payload_missing, child_without_identity, invalid_split_size, inconsistent_revision,
    overlapping_partitions.  Of the store: parent_missing, parent_changed (another revision), parent_replaced,
    incomplete_partitions (an identity of the parent in no child), identities_changed (an identity of another event or
    none).  With ``observed`` (``identity, observed_ms``) also source_observation_missing for a child none of whose
    identities was observed, and source_observation_time_invalid for times not above 0 or after ``now_ms``.

    A null parent id is a parent that is missing; an empty plan gives no rows; other columns are ignored.
    """
    given = cut(_given(plan.withColumn("parent_id", F.coalesce("parent_id", F.lit("")))))
    log = versions(spark, folder)
    checked = _against(given, _latest(_all(spark, log, "changes", CHANGES)), _owners(spark, log))
    if observed is None:
        return checked
    seen = observed.groupBy("identity").agg(F.count("observed_ms").alias("n"), F.bool_or((F.col("observed_ms") <= 0) | (F.col("observed_ms") > F.lit(now_ms))).alias("odd"))
    each = given.select("parent_id", "child", F.explode_outer("identities").alias("identity")).join(seen, "identity", "left")
    each = each.groupBy("parent_id", "child").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or("odd"), F.lit(False)).alias("odd"))
    late = each.groupBy("parent_id").agg(F.array_compact(F.array(F.when(F.bool_or(F.col("n") == 0), "source_observation_missing"), F.when(F.bool_or("odd"), "source_observation_time_invalid"))).alias("late"))
    return checked.join(late, "parent_id").select("parent_id", "children", F.array_sort(F.concat("blockers", "late")).alias("blockers"))


def apply_splits(spark: SparkSession, folder: str, operation: str, plan: DataFrame, cursor: int) -> DataFrame:
    """Apply all splits of a plan in one version of the log; returns ``parent_id, child, event_id, revision, cursor``.

    Every child becomes a new event of revision 1 that takes over its identities; the parent gets one more revision, with
    its payload and ``replaced_by``, the children in order of their numbers; its history stays.  Cursors go on from the
    log's by parent, children before their parent (whose ``child`` is null here).

    All or nothing: SplitConflict if the log isn't at ``cursor``, if any split has a blocker (see ``preflight``), if what
    was written doesn't hold each moved identity once, or if another writer was first.  An operation that is in the log
    returns what it returned then and raises ReusedBatch for another plan.  An empty plan makes a version without changes.
    """
    given = cut(_given(plan))
    told = f"split:{input_hash(given)}"
    log = versions(spark, folder)
    for e in log:
        if e["batch_id"] == operation:
            if e["input_hash"] != told:
                raise ReusedBatch(f"operation {operation} was committed with another plan")
            return spark.read.schema(APPLIED).parquet(f"{e['data']}/result")
    at = log[-1]["cursor"] if log else 0
    if at != cursor:
        raise SplitConflict(f"the log is at {at}, the plan at {cursor}")
    events = cut(_latest(_all(spark, log, "changes", CHANGES)).join(given.select(F.col("parent_id").alias("event_id")).distinct(), "event_id", "left_semi"))
    blocked = _against(given, events, _owners(spark, log)).where(F.size("blockers") > 0)
    # A parent without an id isn't joined with anything and stands out here too.
    if wrong := blocked.orderBy("parent_id").limit(5).collect():
        raise SplitConflict("; ".join(f"{r.parent_id}: {','.join(r.blockers)}" for r in wrong))
    child = F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws("|", F.lit(operation), "parent_id", F.col("child").cast("string")), 256), 1, 32))
    children = cut(given.withColumn("event_id", child))
    made = children.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("child", "event_id"))), lambda x: x.event_id).alias("replaced_by"))
    retired = made.join(events.select(F.col("event_id").alias("parent_id"), F.col("revision") + 1, "payload").toDF("parent_id", "revision", "payload"), "parent_id")
    none = F.lit(None).cast("array<string>")
    rows = children.select("parent_id", "child", "event_id", F.lit(1).cast("long").alias("revision"), "payload", none.alias("replaced_by")).unionByName(
        retired.select("parent_id", F.lit(None).cast("long").alias("child"), F.col("parent_id").alias("event_id"), "revision", "payload", "replaced_by"))
    rows = cut(_numbered(rows.withColumn("order", F.struct("parent_id", F.col("child").isNull(), "child")), "order", cursor))
    version, data = len(log) + 1, f"{folder}/data/{uuid.uuid4().hex}"
    hashed = F.sha2(F.concat(F.coalesce("payload", F.lit("")), F.coalesce(F.concat(F.lit("|"), F.array_join("replaced_by", ",")), F.lit(""))), 256)
    rows.select("event_id", "revision", "cursor", hashed.alias("content_hash"), "payload", "replaced_by").write.parquet(f"{data}/changes")
    children.select(F.explode("identities").alias("identity"), "event_id", F.lit(version).cast("long").alias("version")).write.parquet(f"{data}/identities")
    rows.select("parent_id", "child", "event_id", "revision", "cursor").write.parquet(f"{data}/result")
    # What was written is read again before it counts.
    moved = spark.read.schema(IDENTITIES).parquet(f"{data}/identities").select("identity")
    held = _owners(spark, log).join(events.select("event_id"), "event_id", "left_semi").select("identity")
    whole = moved.exceptAll(held).isEmpty() and held.exceptAll(moved).isEmpty() and spark.read.schema(CHANGES).parquet(f"{data}/changes").count() == rows.count()
    entry = {"version": version, "batch_id": operation, "input_hash": told, "cursor": cursor + rows.count(), "data": data}
    if whole and _published(spark, f"{folder}/log/{version:020d}.json", json.dumps(entry)):
        return spark.read.schema(APPLIED).parquet(f"{data}/result")
    _, store, lost = _fs(spark, data)
    store.delete(lost, True)
    raise SplitConflict("another writer was first" if whole else "the written identities aren't those of the parents")
