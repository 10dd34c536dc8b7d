"""The continuity ledger over micro-batches: a batch meets an index of the stored entries, not the entries.

Below a shared folder stand ``data/<one folder a try>/{entries, index, events}`` and ``log/<batch>.json``, made in one
atomic step, which lists the live data.  Data of lost tries is never read.

``index`` has ``token, place``: what an entry can be found by (its ids, reports and URLs, pairs of words of its title in
slots of 12 hours, its cell in slots of 3 hours).  Tokens of an earlier content stay until compaction; they only bring
an entry that the rules then reject.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.commits import ReusedBatch, _fs, _published, input_hash
from strandline.operators.continuity import ALIKE, CELL, ENTRY, EVENT, NEAR_KM, NEAR_MS, WINDOW_MS, _features, apply_ledger
from strandline.operators.spatial import _cells
from strandline.operators.state import RETENTION_MS
from strandline.session import cut

EVENTS = "ord long, stable_id string, fused_id string, lifecycle string, first_ms long, last_ms long, changed_ms long, update_count long, change_sequence long"
KEPT = (*ENTRY, "version")


def _title_pairs(words: Column) -> Column:
    """Hashes of the pairs among a title's first words in hash order: two titles that are alike share one.

    As ``fusion.rare_pairs``, but in an order that doesn't hang on the other rows, so that stored tokens stay valid.
    """
    ordered = F.array_sort(F.array_distinct(words))
    most = F.size(ordered) - F.ceil(F.size(ordered) * ALIKE - 1e-9) + 2
    first = F.slice(ordered, 1, most.cast("int"))
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda y: F.xxhash64(x, y))))
    return F.when(F.size(ordered) == 1, F.transform(ordered, lambda w: F.xxhash64(w))).otherwise(pairs)


def _tokens(features: DataFrame, asks: bool) -> DataFrame:
    """``pos, token``: what an entry is found by or, if it ``asks``, what an event looks for: its slots' and cells' neighbours too."""
    f = features.withColumn("free", ~F.col("reported") & (F.size("words") > 0))
    slots = lambda span: F.transform(F.array(*map(F.lit, (-1, 0, 1) if asks else (0,))), lambda d: F.floor(F.col("at_ms") / span) + d)
    around = int(360 / CELL)
    own = F.floor((F.col("lat") + 90) / CELL).cast("int") * around + F.pmod(F.floor((F.col("lng") + 180) / CELL).cast("int"), F.lit(around))
    cells = _cells(F.col("lat"), F.col("lng"), NEAR_KM * 1.01, CELL) if asks else F.array(own)
    ids = F.when(F.col("stable_id").isNotNull(), F.array(F.concat(F.lit("i"), "stable_id"))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.concat("keys", ids), lambda k: F.xxhash64(k))
    crossed = lambda kind, xs, span: F.flatten(F.transform(slots(span), lambda s: F.transform(xs, lambda x: F.xxhash64(F.lit(kind), x, s))))
    none = F.array().cast("array<bigint>")
    titles = F.when(F.col("free"), crossed("t", _title_pairs(F.col("words")), WINDOW_MS)).otherwise(none)
    places = F.when(F.col("free") & F.col("lat").isNotNull() & F.col("lng").isNotNull(), crossed("p", cells, NEAR_MS)).otherwise(none)
    return f.select("pos", F.explode(F.array_distinct(F.concat(keys, titles, places))).alias("token"))


def _last(spark: SparkSession, folder: str, below: int | None = None) -> dict | None:
    """The newest log entry, or the newest before a batch; only that file is read."""
    _, store, log = _fs(spark, f"{folder}/log")
    if not store.exists(log):
        return None
    names = [n for n in (f.getPath().getName() for f in store.listStatus(log)) if n.endswith(".json") and not n.startswith(".")]
    names = [n for n in names if below is None or int(n[:-5]) < below]
    return json.loads(spark.read.text(f"{folder}/log/{max(names)}", wholetext=True).first().value) if names else None


def _entry_of(spark: SparkSession, folder: str, batch: int) -> dict | None:
    found = _last(spark, folder, batch + 1)
    return found if found and found["batch"] == batch else None


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("place").agg(F.max_by(F.struct(*[c for c in KEPT if c != "place"]), "version").alias("e")).select("place", "e.*")


def stored_entries(spark: SparkSession, folder: str) -> DataFrame | None:
    """The entries after the last batch with the columns of ``continuity.ENTRY``, those past retention left out."""
    state = _last(spark, folder)
    if state is None:
        return None
    rows = _latest(spark.read.parquet(*state["entries"]))
    return rows.where(F.lit(state["now_ms"]) - F.col("last_ms") <= state["retention_ms"]).select(*ENTRY)


def told_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all committed batches, with their ``batch``; an empty folder gives no rows."""
    _, store, log = _fs(spark, f"{folder}/log")
    if not store.exists(log):
        return spark.createDataFrame([], f"{EVENTS}, batch long")
    live = spark.read.text(f"{folder}/log/*.json", wholetext=True).select(F.from_json("value", "batch long, data string").alias("e")).select("e.*")
    paths = [f"{r.data}/events" for r in live.collect()]
    return spark.read.schema(f"{EVENTS}, batch long").parquet(*paths)


def continuity_step(events: DataFrame, batch: int, folder: str, retention_ms: int = RETENTION_MS, compact_every: int = 16) -> bool:
    """Match one micro-batch with the ledger in a folder and commit both; whether it was new.

    Events have the columns of ``continuity.EVENT``, ``ord`` (unique, the order of matching) and ``seen_ms``, the time of
    the refresh; the batch's clock is the latest of these and of the batch before.  A batch that is in the log is left as
    it is, and raises ReusedBatch if its rows are others.  Nulls are as in ``continuity``; a null ``seen_ms`` is no time;
    an empty batch is committed without events; other columns are ignored.

    The index is met by its tokens; of the entries only those that it names are compared.  What changes is appended;
    every ``compact_every`` batches entries and index are written anew, without what is past retention or replaced.
    """
    spark = events.sparkSession
    rows = cut(events.select(F.col("ord").cast("long").alias("ord"), F.col("seen_ms").cast("long").alias("seen_ms"), *EVENT))
    told = input_hash(rows)
    if done := _entry_of(spark, folder, batch):
        if done["input_hash"] != told:
            raise ReusedBatch(f"batch {batch} was committed with other rows")
        return False
    before = _last(spark, folder, batch)
    state = before or {"entries": [], "index": [], "cursor": 0, "now_ms": 0, "since": 0}
    now = max(rows.agg(F.max("seen_ms")).first()[0] or 0, state["now_ms"])
    stored = None
    if state["entries"]:
        asked = _tokens(_features(rows.select(F.col("ord").alias("pos"), F.lit(None).cast("string").alias("stable_id"), *EVENT)), True)
        places = spark.read.parquet(*state["index"]).join(asked.select("token").distinct().hint("merge"), "token", "left_semi").select("place").distinct()
        stored = cut(_latest(spark.read.parquet(*state["entries"]).join(places.hint("merge"), "place", "left_semi")).select(*ENTRY))
    out, after, cursor = apply_ledger(stored, rows, now, state["cursor"], retention_ms)
    data = f"{folder}/data/{uuid.uuid4().hex}"
    out.withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{data}/events")
    changed = cut(after.where(F.col("last_ms") == now).withColumn("version", F.lit(batch).cast("long")).select(*KEPT))
    entries, index, since = state["entries"] + [f"{data}/entries"], state["index"] + [f"{data}/index"], state["since"] + 1
    if since >= compact_every:
        whole = changed if not state["entries"] else _latest(spark.read.parquet(*state["entries"]).select(*KEPT).unionByName(changed)).select(*KEPT)
        changed = cut(whole.where(F.lit(now) - F.col("last_ms") <= retention_ms))
        entries, index, since = entries[-1:], index[-1:], 0
    changed.write.parquet(f"{data}/entries")
    _tokens(_features(changed.withColumn("pos", F.col("place"))), False).select("token", F.col("pos").alias("place")).write.parquet(f"{data}/index")
    state = {"batch": batch, "input_hash": told, "now_ms": now, "retention_ms": retention_ms, "cursor": cursor, "since": since, "data": data, "entries": entries, "index": index}
    if _published(spark, f"{folder}/log/{batch:020d}.json", json.dumps(state)):
        return True
    _, store, lost = _fs(spark, data)
    store.delete(lost, True)
    if _entry_of(spark, folder, batch)["input_hash"] != told:
        raise ReusedBatch(f"batch {batch} was committed with other rows")
    return False


def continuity_stream(events: DataFrame, folder: str, checkpoint: str, retention_ms: int = RETENTION_MS, compact_every: int = 16) -> StreamingQuery:
    """``continuity_step`` for each micro-batch of what is there; started again it goes on where it was.

    However events are cut into micro-batches, they get the same identities and lifecycles if batches follow each other
    in ``ord``.  A stream that lost its checkpoint runs its batches again; those in the log stay as they are.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        continuity_step(batch, batch_id, folder, retention_ms, compact_every)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
