"""State over batches: snapshots, change logs, the continuity ledger, upserts and identity reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from strandline.operators.graph import connected_components
from strandline.session import fresh

RETENTION_MS = 48 * 3_600_000


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def deterministic_uuid(text: Column) -> Column:
    h = F.sha2(text, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cursor_token(epoch: Column, cursor: Column) -> Column:
    """Opaque base64url token of a position in the change log."""
    token = F.base64(F.to_binary(F.to_json(F.struct(epoch.alias("epoch"), cursor.alias("cursor"))), F.lit("utf-8")))
    return F.rtrim(F.translate(token, "+/=", "-_ "))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``keys, change``: entered, exited or changed between two snapshots; equal rows don't appear."""
    a = before.select(*keys, F.col(content).alias("old"), F.lit(True).alias("was"))
    b = after.select(*keys, F.col(content).alias("new"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "entered").when(F.col("now").isNull(), "exited").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change IS NOT NULL")


def tripwire(members: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Enter and exit events between consecutive snapshots ``at`` (dense integers); the first one is silent."""
    bounds = members.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    m = members.select(*keys, at).distinct()
    ident = [*keys, at]
    entered = m.join(m.withColumn(at, F.col(at) + 1), ident, "left_anti").withColumn("event", F.lit("enter"))
    exited = m.withColumn(at, F.col(at) + 1).join(m, ident, "left_anti").withColumn("event", F.lit("exit"))
    return entered.unionByName(exited).join(F.broadcast(bounds), (F.col(at) > F.col("lo")) & (F.col(at) <= F.col("hi"))).drop("lo", "hi")  # one row


def upsert_latest(stored: DataFrame, arriving: DataFrame, keys: list[str], order: str, now_ms: int, ttl_ms: int = RETENTION_MS) -> DataFrame:
    """Stored and arriving rows, the newest of each key, without those past their time to live."""
    both = stored.unionByName(arriving)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest]).where(F.col(order) > now_ms - ttl_ms)


def revisions(batches: DataFrame, key: str, batch: str, content: str) -> DataFrame:
    """The change log of versioned rows: one revision wherever a key's content differs from its last batch.

    Returns ``key, batch, content, revision, cursor``; cursors number all changes by batch, then key.  The cursor is
    a running number over changes alone; its per-batch offsets are prefix sums over batches, so that the numbering
    within a batch is the only ordered work.
    """
    own = Window.partitionBy(key).orderBy(batch)
    changed = batches.withColumn("before", F.lag(content).over(own)).withColumn("nth", F.row_number().over(own)).where((F.col("nth") == 1) | ~F.col(content).eqNullSafe(F.col("before")))
    changed = changed.withColumn("revision", F.row_number().over(own)).select(key, batch, content, "revision")
    sizes = changed.groupBy(batch).agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("offset", F.sum("n").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))).select(batch, F.coalesce("offset", F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(batch).orderBy(key))
    return changed.join(offsets, batch).withColumn("cursor", F.col("offset") + within).drop("offset")


def ledger(batches: DataFrame, key: str, batch: str, content: str, retention: int) -> DataFrame:
    """Lifecycle of identities over batches: new, updated or ongoing, with counters and change sequence.

    An identity that was away for more than ``retention`` batches is new again.  All state is running windows over
    an identity's own rows; only the sequence looks across identities, by batch and key.
    """
    own = Window.partitionBy(key).orderBy(batch)
    t = batches.withColumn("gap", F.col(batch) - F.lag(batch).over(own))
    t = t.withColumn("fresh", (F.col("gap").isNull() | (F.col("gap") > retention)).cast("int"))
    t = t.withColumn("life", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy(key, "life").orderBy(batch)
    t = t.withColumn("lifecycle", F.when(F.col("fresh") == 1, "new").when(~F.col(content).eqNullSafe(F.lag(content).over(life)), "updated").otherwise("ongoing"))
    so_far = life.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("update_count", F.sum((F.col("lifecycle") == "updated").cast("int")).over(so_far)).withColumn("first_seen", F.min(batch).over(so_far))
    changes = t.where("lifecycle <> 'ongoing'")
    sizes = changes.groupBy(F.col(batch).alias("b")).agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = changes.withColumn("within", F.row_number().over(Window.partitionBy(batch).orderBy(key))).join(offsets, F.col(batch) == F.col("b"))
    numbered = numbered.select(F.col(key).alias("k"), F.col(batch).alias("kb"), (F.col("offset") + F.col("within")).alias("seq"))
    t = t.join(numbered, (F.col(key) == F.col("k")) & (F.col(batch) == F.col("kb")), "left")
    sequence = F.last("seq", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return t.select(key, batch, "lifecycle", "update_count", "first_seen", sequence.alias("change_sequence"))


def last_known(messages: DataFrame, key: str, at: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """The newest message of each key that is not older than ``ttl_ms``."""
    return messages.groupBy(key).agg(F.max_by(F.struct(*[c for c in messages.columns if c not in (key, at)]), at).alias("v"), F.max(at).alias(at)).where(F.col(at) >= now_ms - ttl_ms).select(key, at, "v.*")


def rate_limit(requests: DataFrame, key: str, at: str, order: str, most: int = 20, span_ms: int = 60_000) -> DataFrame:
    """Adds whether a request is allowed in its key's fixed window; a window begins with the first request after the last ended.

    A request ``span_ms`` after the window's first still belongs to it.  Rows pass in order of key and time and only
    the open window is held, so a key may have any number of requests; those without a time share one window.
    """
    spare = fresh(requests, "limited_key")
    names = [*requests.columns, "allowed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n = None, None, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(batch.schema.get_field_index(spare)).to_pylist(), batch.column(batch.schema.get_field_index(at)).to_pylist()):
                if n == 0 or k != now or (t is None) != (start is None) or (t is not None and t > start + span_ms):
                    now, start, n = k, t, 0
                n += 1
                allowed.append(n <= most)
            kept = [c for name, c in zip(batch.schema.names, batch.columns) if name != spare]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(allowed, pa.bool_())], names)

    # The key travels as text, so that equal keys compare equal whatever their type.
    keyed = requests.withColumn(spare, F.to_json(F.struct(F.col(key).alias("k"))))
    ordered = keyed.repartition(F.col(spare)).sortWithinPartitions(spare, at, order)
    return ordered.mapInArrow(run, StructType([*requests.schema.fields, StructField("allowed", BooleanType())]))


def identity_conflicts(links: DataFrame, candidate: str, stored: str, order: str) -> DataFrame:
    """``candidate, verdict``: multiple if it meets several stored ids, repeated if an earlier one holds its id, else accepted.

    Candidates with several ids reserve none.
    """
    ids = links.groupBy(candidate).agg(F.collect_set(stored).alias("ids"), F.min(order).alias("at"))
    single = F.when(F.size("ids") == 1, F.col("ids")[0])
    t = ids.withColumn("id", single)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("at", candidate))
    verdict = F.when(F.col("id").isNull(), "multiple").when(nth > 1, "repeated").otherwise("accepted")
    return t.select(candidate, verdict.alias("verdict"))


def match_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Components of a bipartite match graph, by how many stored and current ids each has.

    ``kind`` is consistent (one and one), split (one stored, several current), merge, or overlap.
    """
    edges = links.select(F.concat(F.lit("s:"), F.col(left).cast("string")).alias("src"), F.concat(F.lit("c:"), F.col(right).cast("string")).alias("dst"))
    parts = connected_components(edges)
    n = parts.groupBy("component").agg(F.count_if(F.col("node").startswith("s:")).alias("stored"), F.count_if(F.col("node").startswith("c:")).alias("current"))
    s, c = F.col("stored"), F.col("current")
    kind = F.when((s == 1) & (c == 1), "consistent").when(s == 1, "split").when(c == 1, "merge").otherwise("overlap")
    return n.withColumn("kind", kind)


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def presence(rows: DataFrame, key: str, at: str, content: str, hit_ms: int, miss_ms: int) -> DataFrame:
    """``key, at, kind, n``: arrivals, updates and retirements of keys that are reported again and again (``at`` in ms).

    A report is an arrival if its key is not present, an update if the content differs from that of the report before,
    else nothing.  A key retires ``hit_ms`` after its last report, or ``miss_ms`` after one without content, unless there
    is one before or then; a time that the latest report of all hasn't passed is open still.  ``n`` counts the reports that
    arrived or changed since the arrival.  Equal times are taken in order of content, nulls first; repeated reports are
    one; a null key is a key, reports without a time are left out.
    """
    k, t, c = F.col(key), F.col(at), F.col(content)
    r = rows.where(t.isNotNull()).select(k.alias("key"), t.cast("long").alias("at"), c.cast("string").alias("content")).distinct()
    w = Window.partitionBy("key").orderBy("at", F.col("content").asc_nulls_first())
    r = r.withColumn("ends", F.col("at") + F.when(F.col("content").isNull(), miss_ms).otherwise(hit_ms))
    r = r.withColumns({"fresh": F.coalesce(F.col("at") > F.lag("ends").over(w), F.lit(True)), "next": F.lead("at").over(w)})
    kind = F.when(F.col("fresh"), "arrival").when(~F.col("content").eqNullSafe(F.lag("content").over(w)), "update")
    r = r.withColumn("kind", kind).withColumn("life", F.sum(F.col("fresh").cast("int")).over(w))
    so_far = Window.partitionBy("key", "life").orderBy("at", F.col("content").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("n", F.count("kind").over(so_far))
    top = rows.agg(F.max(t.cast("long"))).first()[0]
    gone = r.where(F.coalesce(F.col("next") > F.col("ends"), F.col("ends") < F.lit(top)))
    return r.where("kind IS NOT NULL").select("key", "at", "kind", "n").unionByName(gone.select("key", F.col("ends").alias("at"), F.lit("retirement").alias("kind"), "n"))
