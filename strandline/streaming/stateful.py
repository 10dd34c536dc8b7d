"""Structured Streaming forms of the stateful operators: windows, last-known state, sinks and change feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandline.operators.feed import feed_rollup


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, with ``at`` as event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, at: str, key: str, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window; events later than the watermark are dropped by Spark."""
    return events.withWatermark(at, late).groupBy(F.window(at, span), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_reports(events: DataFrame, at: str, key: list[str], late: str = "48 hours") -> DataFrame:
    """The first event of every key; state goes after the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def rate_limited(events: DataFrame, at: str, key: str, most: int, span: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Keys and windows with more than ``most`` requests."""
    return windowed_counts(events, at, key, span, late).where(F.col("n") > most)


def _ledger_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["at", "content"], kind="stable")
    content, updates, first = state.get if state.exists else (None, 0, None)
    out = []
    for r in rows.itertuples(index=False):
        life = "new" if first is None else "updated" if r.content != content else "ongoing"
        first = r.at if first is None else first
        updates += life == "updated"
        content = r.content
        out.append((key[0], r.at, life, updates, first))
    state.update((content, updates, first))
    state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 48 * 3_600_000)
    yield pd.DataFrame(out, columns=["key", "at", "lifecycle", "update_count", "first_seen"])


def ledger_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Lifecycle of each ``key`` over ``at, content`` events: new, updated or ongoing; forgotten after 48 hours without any."""
    kept = events.select("key", "at", "content").withWatermark("at", late)
    return kept.groupBy("key").applyInPandasWithState(
        _ledger_step, "key string, at timestamp, lifecycle string, update_count bigint, first_seen timestamp", "content string, updates bigint, first timestamp", "append", GroupStateTimeout.EventTimeTimeout,
    )


def commit_batches(events: DataFrame, table: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Append each micro-batch's newest row of every key to a table of versions, once a batch id.

    The batch id is a partition that is overwritten, so a batch that is run again replaces itself.
    """
    def commit(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in key and c != order]
        newest = batch.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("v")).select(*key, "v.*")
        newest.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_stream(signals: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """The feed rollup of every micro-batch, as JSON snapshots."""
    def write(batch: DataFrame, batch_id: int) -> None:
        feed_rollup(batch).write.mode("overwrite").json(f"{sink}/batch={batch_id}")

    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PRESENCE = "key string, at timestamp, kind string, n bigint"


def presence_stream(reports: DataFrame, hit: str = "24 hours", miss: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``state.presence`` of ``key, at, content`` reports as a stream: arrivals, updates and retirements by event time.

    A key's state is its last report; a timer at its end emits the retirement and drops the state once the watermark has
    passed.  A key that reports again after its end, before that timer, retires and arrives, so that the result doesn't
    hang on how reports are cut into micro-batches.  Reports before the key's last one are late and change nothing.
    """
    hit_ms, miss_ms = (int(pd.Timedelta(span).total_seconds() * 1000) for span in (hit, miss))
    names = [c.split()[0] for c in PRESENCE.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, ends, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(ends, unit="ms"), "retirement", n)], columns=names)
            return
        said, last, ends, n = state.get if state.exists else (None, None, None, 0)
        rows = sorted({(int(r.at.timestamp() * 1000), r.content is not None, r.content) for b in batches for r in b.itertuples(index=False)}, key=lambda r: (r[0], r[1], r[2] or ""))
        out = []
        for at, hits, content in rows:
            if last is not None and at < last:
                continue
            if ends is not None and at > ends:
                out.append((key[0], ends, "retirement", n))
                ends, n = None, 0
            if ends is None or content != said:
                n += 1
                out.append((key[0], at, "arrival" if ends is None else "update", n))
            said, last, ends = content, at, at + (hit_ms if hits else miss_ms)
        state.update((said, last, ends, n))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))

    kept = reports.select("key", "at", "content").withWatermark("at", late)
    return kept.groupBy("key").applyInPandasWithState(step, PRESENCE, "said string, last bigint, ends bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeats(events: DataFrame, key: str, idle: str = "15 seconds") -> DataFrame:
    """``channel, sequence, kind, n``: a change message for each micro-batch of a channel and a heartbeat whenever it was idle that long.

    ``n`` counts the events of the message; the sequence goes on through both kinds, so that a client sees what it missed.
    The timer is one of processing time: beats come while no data does.  Only the channel's
    name travels to its task, which keeps one number.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = ["channel", "sequence", "kind", "n"]

    def step(channel: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence = (state.get[0] if state.exists else 0) + 1
        beat = state.hasTimedOut
        n = 0 if beat else sum(len(b) for b in batches)
        state.update((sequence,))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame([(channel[0], sequence, "heartbeat" if beat else "change", n)], columns=names)

    kept = events.select(F.col(key).cast("string").alias("channel"))
    return kept.groupBy("channel").applyInPandasWithState(step, "channel string, sequence bigint, kind string, n bigint", "sequence bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
