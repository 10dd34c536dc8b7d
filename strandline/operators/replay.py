"""Clients of a transaction log: a snapshot with a cursor, pages of changes after a cursor, and resets.

A cursor token names the store it was given by, the last change it has and, between the pages of one replay, the change
up to which that replay goes, so that later commits don't mix into it.
"""

from __future__ import annotations

import base64
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.operators.commits import CHANGES, _all, _fs, _latest, _published, versions

PAGE, MOST_PAGE, PAGES, LONGEST = 100, 300, 20, 512


class CursorResetRequired(ValueError):
    """A cursor that is no cursor of this store, or one whose changes aren't kept: begin with a snapshot."""


class Page(NamedTuple):
    changes: DataFrame
    token: str
    has_more: bool
    through: int


def _encode(epoch: str, after: int, through: int | None) -> str:
    return base64.urlsafe_b64encode(json.dumps({"epoch": epoch, "after": after, "through": through}).encode()).decode().rstrip("=")


def _decode(token: str) -> tuple[str, int, int | None]:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    try:
        if len(token) > LONGEST:
            raise ValueError
        said = json.loads(base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True))
        if not (isinstance(said["epoch"], str) and whole(said["after"]) and (said["through"] is None or whole(said["through"]))):
            raise ValueError
        return said["epoch"], said["after"], said["through"]
    except (ValueError, KeyError, TypeError) as wrong:
        raise CursorResetRequired("no cursor of this store") from wrong


def _epoch(log: list[dict]) -> str:
    """A store is named by the data of its first version: one that is made anew has another name."""
    return log[0]["data"].rsplit("/", 1)[-1] if log else ""


def retention_floor(spark: SparkSession, folder: str) -> int:
    """The change after which replays may begin; 0 where none was set."""
    _, store, kept = _fs(spark, f"{folder}/floor")
    return max((int(f.getPath().getName()[:-5]) for f in store.listStatus(kept) if f.getPath().getName()[:1].isdigit()), default=0) if store.exists(kept) else 0


def keep_after(spark: SparkSession, folder: str, cursor: int) -> int:
    """No longer replay changes up to ``cursor``; the floor never falls and never passes the log.  Returns the floor."""
    log = versions(spark, folder)
    asked = min(cursor, log[-1]["cursor"] if log else 0)
    if asked > retention_floor(spark, folder):
        _published(spark, f"{folder}/floor/{asked:020d}.json", json.dumps({"floor": asked}))
    return retention_floor(spark, folder)


def bootstrap(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """All events as they are (``commits.current_events``) and the cursor that goes with them, of one version of the log."""
    log = versions(spark, folder)
    return _latest(_all(spark, log, "changes", CHANGES)), _encode(_epoch(log), log[-1]["cursor"] if log else 0, None)


def _range(spark: SparkSession, folder: str, token: str | None) -> tuple[list[dict], str, int, int]:
    log = versions(spark, folder)
    top, floor = log[-1]["cursor"] if log else 0, retention_floor(spark, folder)
    epoch, after, through = _decode(token) if token else (_epoch(log), 0, None)
    through = top if through is None else through
    if epoch != _epoch(log) or not floor <= after <= through <= top:
        raise CursorResetRequired("the cursor is of another store or its changes are no longer kept")
    return log, epoch, after, through


def _between(spark: SparkSession, log: list[dict], after: int, through: int) -> DataFrame:
    """The changes of a range of cursors; only versions that overlap it are read."""
    starts = [0, *[e["cursor"] for e in log]]
    met = [e for e, start in zip(log, starts) if e["cursor"] > after and start < through]
    return _all(spark, met, "changes", CHANGES).where((F.col("cursor") > after) & (F.col("cursor") <= through))


def changes(spark: SparkSession, folder: str, token: str | None = None, most: int = PAGE) -> Page:
    """The next ``most`` (1 to 300) changes after a token, in order of ``cursor``; without a token from the beginning.

    Cursors have no gaps, so a page is a range of them, and nothing is sorted to find it.  While there is more, the token
    holds the end of the replay.  CursorResetRequired if the token can't be read, is of another store, lies before the
    retention floor or beyond the log.
    """
    log, epoch, after, through = _range(spark, folder, token)
    end = min(through, after + max(1, min(MOST_PAGE, int(most))))
    more = end < through
    return Page(_between(spark, log, after, end).orderBy("cursor"), _encode(epoch, end, through if more else None), more, through)


def synchronise(spark: SparkSession, folder: str, have: DataFrame | None, token: str | None) -> tuple[DataFrame, str, str]:
    """A client's events brought up to date: the events, their token, and ``changes`` or ``bootstrap``, how it came about.

    ``have`` are the events that go with the token.  Changes are taken in up to 20 pages of 300, which are read as the one
    range they make; of an event the latest cursor counts, whatever the client had.  A client without events or token, one
    whose token asks for a reset, and one that is further behind begin with a snapshot.  Other columns of ``have`` go.
    """
    if have is None or not token:
        return *bootstrap(spark, folder), "bootstrap"
    try:
        log, epoch, after, through = _range(spark, folder, token)
    except CursorResetRequired:
        return *bootstrap(spark, folder), "bootstrap"
    if through - after > PAGES * MOST_PAGE:
        return *bootstrap(spark, folder), "bootstrap"
    columns = ["event_id", "revision", "cursor", "content_hash", "payload", "replaced_by"]
    both = have.select(*columns).unionByName(_between(spark, log, after, through).select(*columns))
    latest = both.groupBy("event_id").agg(F.max_by(F.struct(*columns[1:]), "cursor").alias("v")).select("event_id", "v.*")
    return latest, _encode(epoch, through, None), "changes"
