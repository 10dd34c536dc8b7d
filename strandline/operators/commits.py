"""A transaction log of event revisions over Parquet: batches are written whole or not at all, once each.

Below a shared folder stand ``data/<one folder a try>/{changes, identities, result}`` and ``log/<version>.json``.  A version exists
once its log file does; that file is made in one atomic step that fails if another writer was first, so data of lost
tries and lost executors is never read.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.session import cut

CHANGES = "event_id string, revision bigint, cursor bigint, content_hash string, payload string, replaced_by array<string>"
IDENTITIES = "identity string, event_id string, version bigint"
RESULT = "identity string, event_id string, revision bigint, cursor bigint, changed boolean"


class ReusedBatch(ValueError):
    """A batch id that was committed with other input."""


class RevisionConflict(ValueError):
    """A write that expects another revision than its event has."""


class IdentityConflict(ValueError):
    """A write whose identities belong to several events, or an identity in several writes."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _published(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with this content unless there is one; whether it was made."""
    jvm, store, target = _fs(spark, path)
    store.mkdirs(target.getParent())
    own = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = store.create(own, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if store.getScheme() == "file":  # a hard link is atomic and never replaces
            os.link(urlparse(own.toString()).path, urlparse(target.toString()).path)
            store.delete(own, False)
        else:
            none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri()).rename(own, target, options)
        return True
    except Exception:
        store.delete(own, False)
        if store.exists(target):
            return False
        raise


def versions(spark: SparkSession, folder: str) -> list[dict]:
    """The committed batches in order: one small entry each."""
    _, store, log = _fs(spark, f"{folder}/log")
    if not store.exists(log):
        return []
    found = spark.read.text(f"{folder}/log/*.json", wholetext=True).collect()
    return sorted((json.loads(r.value) for r in found), key=lambda e: e["version"])


def _all(spark: SparkSession, log: list[dict], part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{e['data']}/{part}" for e in log]) if log else spark.createDataFrame([], schema)


def current_events(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """``event_id, revision, cursor, content_hash, payload, replaced_by`` of every event as of a version, by default the last."""
    log = [e for e in versions(spark, folder) if version is None or e["version"] <= version]
    return _latest(_all(spark, log, "changes", CHANGES))


def _latest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("event_id").agg(F.max_by(F.struct("revision", "cursor", "content_hash", "payload", "replaced_by"), "revision").alias("v")).select("event_id", "v.*")


def changes_after(spark: SparkSession, folder: str, cursor: int) -> DataFrame:
    """Every revision with a later cursor, by whole versions first: older versions' files are not read."""
    return _all(spark, [e for e in versions(spark, folder) if e["cursor"] > cursor], "changes", CHANGES).where(F.col("cursor") > cursor)


def current_identities(spark: SparkSession, folder: str) -> DataFrame:
    """``identity, event_id``: the event that each identity belongs to after the last version."""
    return _owners(spark, versions(spark, folder))


def _owners(spark: SparkSession, log: list[dict]) -> DataFrame:
    return _all(spark, log, "identities", IDENTITIES).groupBy("identity").agg(F.max_by("event_id", "version").alias("event_id"))


def input_hash(writes: DataFrame) -> str:
    """The same for the same rows in any order: their number and the sums of two hashes."""
    row = F.to_json(F.struct(*sorted(writes.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    found = writes.agg(F.count("*").cast("string"), *sums).first()
    return ":".join(x or "0" for x in found)


def _numbered(rows: DataFrame, order: str, after: int) -> DataFrame:
    """``cursor``: the place of each row in the order, counted from ``after``; only a number a partition goes to the driver."""
    local = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    split = local.withColumn("pid", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1))
    before, starts = after, []
    for r in sorted(split.groupBy("pid").agg(F.count("*").alias("n")).collect(), key=lambda r: r.pid):
        starts.append((r.pid, before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(starts, "pid long, before long")
    return split.join(F.broadcast(offsets), "pid").withColumn("cursor", F.col("before") + F.col("nth") + 1).drop("at", "pid", "nth", "before")


def commit(spark: SparkSession, folder: str, batch_id: str, writes: DataFrame, tries: int = 5) -> DataFrame:
    """Commit ``identities array<string>, payload string, expected_revision long`` as one batch; returns ``identity, event_id, revision, cursor, changed``.

    A write belongs to the event that has one of its identities, else to a new one named by batch and smallest identity.  A
    new payload makes the next revision, with the next cursor in order of the smallest identity, if the event has the
    expected revision (null: none); an equal payload changes nothing.  Identities without an event yet join the write's.

    A batch id that is in the log returns what it returned then, and raises ReusedBatch for other input.  Any write with
    another expected revision raises RevisionConflict, identities of several events or in several writes raise
    IdentityConflict, and then nothing is committed.  Of racing writers one is first; the others begin again on its version.
    Repeated equal writes are one; null or empty identities are none, and a write without any is an IdentityConflict; an
    empty batch commits no change; other columns are ignored.
    """
    given = writes.select(F.array_sort(F.array_distinct(F.filter("identities", lambda x: F.length(x) > 0))).alias("identities"), F.col("payload").cast("string").alias("payload"), F.col("expected_revision").cast("long").alias("expected")).distinct()
    given = cut(given.withColumn("first", F.get("identities", F.lit(0))))
    told = input_hash(given)
    named = given.select("first", F.explode("identities").alias("identity"))
    if not given.where("first IS NULL").isEmpty() or not named.groupBy("identity").count().where("count > 1").isEmpty():
        raise IdentityConflict("a write has no identity, or an identity is in several writes")
    for _ in range(tries):
        log = versions(spark, folder)
        for e in log:
            if e["batch_id"] == batch_id:
                if e["input_hash"] != told:
                    raise ReusedBatch(f"batch {batch_id} was committed with other input")
                return spark.read.schema(RESULT).parquet(f"{e['data']}/result")
        cursor = log[-1]["cursor"] if log else 0
        known = named.join(_owners(spark, log), "identity").groupBy("first").agg(F.min("event_id").alias("known"), F.max("event_id").alias("other"))
        known = cut(known)
        if not known.where("known <> other").isEmpty():
            raise IdentityConflict("the identities of a write belong to several events")
        now = _latest(_all(spark, log, "changes", CHANGES)).select(F.col("event_id").alias("known"), "revision", F.col("cursor").alias("was_at"), "content_hash")
        content = F.sha2(F.coalesce("payload", F.lit("")), 256)
        met = given.join(known.drop("other"), "first", "left").join(now, "known", "left").withColumn("hash", content)
        met = cut(met.withColumn("changed", F.col("revision").isNull() | (F.col("hash") != F.col("content_hash"))))
        if n := met.where(F.col("changed") & ~F.col("revision").eqNullSafe(F.col("expected"))).count():
            raise RevisionConflict(f"{n} writes expect another revision")
        fresh = F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws("|", F.lit(batch_id), "first"), 256), 1, 32))
        met = met.withColumn("event_id", F.coalesce("known", fresh)).withColumn("next", F.coalesce("revision", F.lit(0)) + F.col("changed").cast("long"))
        changes = cut(_numbered(met.where("changed"), "first", cursor))
        data = f"{folder}/data/{uuid.uuid4().hex}"
        changes.select("event_id", F.col("next").alias("revision"), "cursor", F.col("hash").alias("content_hash"), "payload", F.lit(None).cast("array<string>").alias("replaced_by")).write.parquet(f"{data}/changes")
        found = named.join(met.select("first", "event_id"), "first").select("identity", "event_id", F.lit(len(log) + 1).cast("long").alias("version"))
        found.join(_all(spark, log, "identities", IDENTITIES).select("identity"), "identity", "left_anti").write.parquet(f"{data}/identities")
        same = met.where("NOT changed").select(F.col("first").alias("identity"), "event_id", F.col("next").alias("revision"), F.col("was_at").alias("cursor"), "changed")
        changes.select(F.col("first").alias("identity"), "event_id", F.col("next").alias("revision"), "cursor", "changed").unionByName(same).write.parquet(f"{data}/result")
        entry = {"version": len(log) + 1, "batch_id": batch_id, "input_hash": told, "cursor": cursor + changes.count(), "data": data}
        if _published(spark, f"{folder}/log/{entry['version']:020d}.json", json.dumps(entry)):
            return spark.read.schema(RESULT).parquet(f"{data}/result")
        _, store, lost = _fs(spark, data)
        store.delete(lost, True)
    raise RevisionConflict(f"other writers were first {tries} times")
