"""The continuity ledger: fused events of a refresh matched with the entries of earlier ones, in the refresh's order.

An event row has ``ord`` (a number from 0, unique in its batch: the order in which events are matched), ``id, title,
description, category, categories, at_ms, lat, lng, reports, urls, nws, content``.  ``categories``, ``urls`` and ``reports``
(source and upstream id of its evidence as one string) are arrays of strings; ``nws`` says that some of the evidence is of
the weather service; ``content`` stands for all that makes a revision.

Nulls: a null title or description is empty, a null time is 0, null arrays are empty, a null or non-finite coordinate is no
place, a null id equals no other.  Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.functions.geo import EARTH_KM
from strandline.functions.text import is_digest, tokens
from strandline.operators.fusion import HOUR, rare_pairs
from strandline.operators.graph import connected_components
from strandline.operators.spatial import _cells
from strandline.operators.state import RETENTION_MS
from strandline.session import cut

WINDOW_MS, NEAR_MS = 12 * HOUR, 3 * HOUR
QUAKE_MS = HOUR // 6
#: What titles must share: alone, or near each other in place and time.
ALIKE, SOME, NEAR_KM, CELL = 0.72, 0.4, 80, 0.8
#: Stored entries come before all rows of a batch: their positions are negative.
BEFORE = 1 << 62
#: Changes are numbered within blocks of so many positions, and blocks by their prefix sums.
BLOCK = 1 << 16

EVENT = ("id", "title", "description", "category", "categories", "at_ms", "lat", "lng", "reports", "urls", "nws", "content")
ENTRY = ("stable_id", *EVENT, "first_ms", "last_ms", "changed_ms", "update_count", "change_sequence", "place")


def _features(rows: DataFrame) -> DataFrame:
    """``pos, stable_id, id, content, keys`` and what the rules compare; every key but an id goes with the digest gate."""
    listed = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    t = rows.withColumns({
        "digest": F.coalesce(is_digest(F.col("title"), F.col("description")), F.lit(False)), "words": tokens(F.coalesce("title", F.lit(""))), "nws": F.coalesce("nws", F.lit(False)),
        "at_ms": F.coalesce("at_ms", F.lit(0)).cast("long"), "lat": finite("lat"), "lng": finite("lng"), "reports": listed("reports"), "urls": listed("urls"), "categories": listed("categories"),
    })
    t = t.withColumns({"lat": F.when(F.col("lng").isNotNull(), F.col("lat")), "lng": F.when(F.col("lat").isNotNull(), F.col("lng")), "reported": F.size("reports") > 0})
    gate = F.when(F.col("digest"), "d").otherwise("p")
    by_report = F.transform("reports", lambda r: F.concat(F.lit("r"), gate, r))
    by_url = F.when(F.col("reported"), F.array().cast("array<string>")).otherwise(F.transform("urls", lambda u: F.concat(F.lit("u"), gate, u)))
    by_id = F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("i"), F.col("id"))))
    return t.select(
        "pos", "stable_id", "id", "content", F.array_distinct(F.concat(by_id, by_report, by_url)).alias("keys"), "digest", "reported", "nws", "at_ms", "lat", "lng",
        F.transform("words", lambda w: F.xxhash64(w)).alias("words"), F.coalesce("category", F.lit("")).alias("category"), "categories",
    )


def _titled(f: DataFrame) -> DataFrame:
    """The rows with ``free`` (they may match by title, place and time), ``title``, ``pairs`` of its rare words, the ``cell`` of a place and the cells in its ``reach``.

    Two titles of which ALIKE is shared have a pair in common.  Words are counted over different titles.
    """
    none, around = F.array().cast("array<long>"), int(360 / CELL)
    own = F.floor((F.col("lat") + 90) / CELL).cast("int") * around + F.pmod(F.floor((F.col("lng") + 180) / CELL).cast("int"), F.lit(around))
    placed = F.col("free") & F.col("lat").isNotNull()
    f = f.withColumn("free", ~F.col("reported") & (F.size("words") > 0))
    f = f.withColumns({
        "title": F.xxhash64(F.when(F.col("free"), F.array_sort("words")).otherwise(F.array("pos"))), "cell": F.when(placed, own.cast("long")),
        "reach": F.when(placed, F.transform(_cells(F.col("lat"), F.col("lng"), NEAR_KM * 1.01, CELL), lambda c: c.cast("long"))).otherwise(none),
    })
    titles = cut(f.where("free").groupBy("title").agg(F.first("words").alias("words")))
    rare = rare_pairs(titles, "title", "words", ALIKE).groupBy("title").agg(F.collect_set("pair").alias("pairs"))
    return f.join(rare.hint("merge"), "title", "left").withColumn("pairs", F.coalesce("pairs", none))


def _stars(f: DataFrame) -> DataFrame:
    """``src, dst``: links that join all rows of which one may hang on another; a row has as many as it has tokens.

    Rows that share an id, a report or a URL, that have a rare pair of words in common within 12 hours, or that stand near
    each other within 3.  They need not match: larger components cost order, never a match.  Rows of one title and slot, and of
    one cell and slot, meet first, and the first of them then meets the other titles and cells.
    """
    slot = lambda span: F.expr(f"floor(at_ms / {span})")
    own = F.when(F.col("stable_id").isNotNull(), F.array(F.concat(F.lit("i"), "stable_id"))).otherwise(F.array().cast("array<string>"))
    exact = F.transform(F.array_distinct(F.concat("keys", own)), lambda k: F.xxhash64(k))
    f = f.withColumns({"half_day": slot(WINDOW_MS), "hours": slot(NEAR_MS)})
    same = F.array_compact(F.array(F.when(F.col("free"), F.xxhash64(F.lit("title"), "title", "digest", "half_day")), F.when(F.col("cell").isNotNull(), F.xxhash64(F.lit("cell"), "cell", "digest", "hours"))))
    told = lambda rows, items: rows.select("pos", F.explode(items).alias("t")).select("pos", "t.*")
    token = lambda x, settled: F.struct(x.alias("token"), settled.alias("settled"))
    titles = f.where("free").groupBy("title", "digest", "half_day").agg(F.min("pos").alias("pos"), F.first("pairs").alias("pairs"))
    cells = f.where("cell IS NOT NULL").groupBy("cell", "digest", "hours", "reach").agg(F.min("pos").alias("pos"))
    both = F.array(F.lit(0), F.lit(1))  # the earlier of two rows in neighbouring slots meets the later one in its slot
    by_title = F.flatten(F.transform("pairs", lambda p: F.transform(both, lambda d: token(F.xxhash64(F.lit("pair"), p, "digest", F.col("half_day") + d), F.lit(True)))))
    # A cell that no row stands in joins nothing.
    by_cell = F.flatten(F.transform("reach", lambda c: F.transform(both, lambda d: token(F.xxhash64(F.lit("near"), c, "digest", F.col("hours") + d), (c == F.col("cell")) & (d == 0)))))
    met = cut(told(f, F.transform(F.concat(exact, same), lambda x: token(x, F.lit(True)))).union(told(titles, by_title)).union(told(cells, by_cell)))
    least = met.groupBy("token").agg(F.min("pos").alias("src"), F.count("*").alias("n"), F.bool_or("settled").alias("settled")).where("n > 1 AND settled")
    return met.join(least.select("token", "src").hint("merge"), "token").where("pos <> src").select("src", F.col("pos").alias("dst")).distinct()


class _Said:
    """What an event says, as the rules compare it."""

    __slots__ = ("content", "keys", "digest", "nws", "at", "lat", "lng", "words", "category", "categories", "pairs", "cells")

    def __init__(self, content, keys, digest, nws, at, lat, lng, words, category, categories, pairs, cells) -> None:
        self.content, self.keys, self.digest, self.nws, self.at, self.lat, self.lng = content, keys, digest, nws, at, lat, lng
        self.words, self.category, self.categories, self.pairs, self.cells = words, category, categories, pairs, cells

    def km(self, other: _Said) -> float | None:
        if self.lat is None or other.lat is None:
            return None
        if self.lat == other.lat and self.lng == other.lng:
            return 0.0
        p, q = math.radians(self.lat), math.radians(other.lat)
        h = math.sin(math.radians(other.lat - self.lat) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(other.lng - self.lng) / 2) ** 2
        return math.asin(min(1.0, math.sqrt(h))) * (2 * EARTH_KM)

    def meets(self, other: _Said) -> bool:
        """Whether the event matches what an entry says by title, place and time."""
        apart = abs(self.at - other.at)
        if apart > WINDOW_MS or self.digest != other.digest or self.nws and other.nws or self.category != other.category and self.categories.isdisjoint(other.categories):
            return False
        share = 1.0 if self.words is other.words else len(self.words & other.words) / max(len(self.words), len(other.words))
        if share < SOME:
            return False
        km = self.km(other)
        # Shocks of one area are told apart unless time, place and title nearly agree.
        if self.category == "earthquake":
            return share >= 0.8 and km is not None and km <= 10 and apart <= QUAKE_MS
        return share >= ALIKE and (km is None or km <= 300) or km is not None and km <= NEAR_KM and apart <= NEAR_MS


class _Entries:
    """The entries of one component by what they say last: numbers in the order of their places, sorted under each token, tokens by slot of time."""

    def __init__(self) -> None:
        self.of: list[list] = []  # stable id, first position of its life, slot, what it says
        self.stables: dict[str, int] = {}
        self.by_key: dict[str, list[int]] = {}
        self.by_title: dict[int, dict[int, list[int]]] = {}
        self.by_shock: dict[int, dict[int, list[int]]] = {}
        self.by_cell: dict[int, dict[int, list[int]]] = {}

    @staticmethod
    def _drop(held: dict, tokens: Iterable, e: int) -> None:
        for token in tokens:
            under = held[token]
            del under[bisect_left(under, e)]
            if not under:
                del held[token]

    @staticmethod
    def _put(held: dict, tokens: Iterable, e: int) -> None:
        for token in tokens:
            if (under := held.get(token)) is None:
                held[token] = [e]
            else:
                insort(under, e)

    def say(self, e: int, said: _Said) -> None:
        """The entry leaves the tokens that it no longer has and comes under the new ones."""
        before = self.of[e][3]
        self.of[e][3] = said
        if before is None or before.keys != said.keys:
            if before is not None:
                self._drop(self.by_key, before.keys, e)
            self._put(self.by_key, said.keys, e)
        for index, span, field in ((self.by_title, WINDOW_MS, "pairs"), (self.by_shock, QUAKE_MS, "pairs"), (self.by_cell, NEAR_MS, "cells")):
            slot, tokens = said.at // span, getattr(said, field)
            if before is not None:
                old, had = before.at // span, getattr(before, field)
                if old == slot and had == tokens:
                    continue
                if had:
                    self._drop(index[old], had, e)
                    if not index[old]:
                        del index[old]
            if tokens:
                self._put(index.setdefault(slot, {}), tokens, e)

    def begin(self, stable: str | None, pos: int, said: _Said) -> int:
        self.of.append([stable, pos, pos, None])
        e = len(self.of) - 1
        self.say(e, said)
        if stable is not None:
            self.stables[stable] = e
        return e

    def first(self, said: _Said, reach: list[int]) -> int | None:
        """The first entry that an event matches; each list is read up to its first match or the best so far."""
        none = len(self.of)
        best = min((self.by_key[k][0] for k in said.keys if k in self.by_key), default=none)
        quake = said.category == "earthquake"
        asked = [(self.by_shock if quake else self.by_title, QUAKE_MS if quake else WINDOW_MS, said.pairs)]
        if not quake:
            asked.append((self.by_cell, NEAR_MS, reach))
        lists = [held[t] for index, span, tokens in asked for s in range(said.at // span - 1, said.at // span + 2) if (held := index.get(s)) for t in tokens if t in held]
        lists.sort(key=itemgetter(0))
        seen = set()
        for listed in lists:
            for e in listed:
                if e >= best:
                    break
                if e not in seen:
                    seen.add(e)
                    if said.meets(self.of[e][3]):
                        best = e
                        break
        return best if best < none else None


NO_WORDS: tuple[frozenset, tuple] = frozenset(), ()
REPLAYED = "pos long, slot long, life long, lifecycle string, stable_id string"
GIVEN = ("pos", "id", "stable_id", "content", "keys", "free", "digest", "nws", "at_ms", "lat", "lng", "title", "words", "category", "categories", "pairs", "cell", "reach")


def _lists(values: pa.ListArray) -> Callable[[int], list]:
    """The list of a row, made when it is asked for."""
    ends = values.offsets.to_numpy()
    items = values.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    ends = (ends - ends[0]).tolist()
    if pa.types.is_string(items.type):
        told = items.to_pylist()
        return lambda i: told[ends[i] : ends[i + 1]]
    numbers = items.to_numpy()
    return lambda i: numbers[ends[i] : ends[i + 1]].tolist()


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match rows (``component`` and the columns of GIVEN) that come in order of component and position with the entries of one component."""
    names = [c.split()[0] for c in REPLAYED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    component, entries, titles, kinds = None, _Entries(), {}, {}
    for batch in batches:
        out = []
        named = dict(zip(("component", *GIVEN), batch.columns))
        words_of, pairs_of, reach_of, keys_of, categories_of = (_lists(named.pop(c)) for c in ("words", "pairs", "reach", "keys", "categories"))
        for i, (group, pos, ident, stable, content, free, digest, nws, at, lat, lng, title, category, cell) in enumerate(zip(*(c.to_pylist() for c in named.values()))):
            if group != component:
                component, entries, titles, kinds = group, _Entries(), {}, {}
            # Equal titles and categories are held once.
            if not free:
                words, pairs = NO_WORDS
            elif (held := titles.get(title)) is not None:
                words, pairs = held
            else:
                words, pairs = titles[title] = frozenset(words_of(i)), tuple(pairs_of(i))
            kind = category, *categories_of(i)
            category, categories = kinds.get(kind) or kinds.setdefault(kind, (category, frozenset(kind[1:])))
            said = _Said(content, keys_of(i), digest, nws, at, lat, lng, words, category, categories, pairs, () if cell is None else (cell,))
            if pos < 0:
                entries.begin(stable, pos, said)
                continue
            found = entries.first(said, reach_of(i))
            if found is not None:
                lifecycle = "ongoing" if entries.of[found][3].content == content else "updated"
                entries.say(found, said)
            elif ident in entries.stables:  # its own id stands for an entry that has become something else: it takes the place
                found, lifecycle = entries.stables[ident], "new"
                entries.say(found, said)
                entries.of[found][1] = pos
            else:
                found, lifecycle = entries.begin(ident, pos, said), "new"
            stable, life, slot = entries.of[found][:3]
            out.append((pos, slot, life, lifecycle, stable))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names)


def apply_ledger(stored: DataFrame | None, incoming: DataFrame, now_ms: int, cursor: int = 0, retention_ms: int = RETENTION_MS) -> tuple[DataFrame, DataFrame, int]:
    """The batch's events with identity and lifecycle, the ledger after it, and its new cursor.

    Each event in order of ``ord`` joins the first entry whose latest content it matches, or begins one: by id, by a
    report, by a URL if neither has reports, or by title, place and time; digests and plain events never match but by id.
    Its content then is the entry's.  Entries not observed for longer than ``retention_ms`` are forgotten.

    Events: ``ord, stable_id, fused_id, lifecycle`` (new, updated, ongoing), ``first_ms, last_ms, changed_ms, update_count,
    change_sequence``.  An empty batch gives no events and the entries that remain.

    What an event becomes may hang on anything in its connected component, so rows of a component pass one task in order.
    That task holds the component's entries and meets each event only with what they say last: no pair of rows is made, there
    or in a join.  Joins of rows are merges: Spark takes a materialised frame for as small as the file it comes from, and would
    send it through the driver to every task.
    """
    rows = incoming.select(F.col("ord").cast("long").alias("pos"), F.lit(None).cast("string").alias("stable_id"), *EVENT)
    kept = None
    if stored is not None:
        kept = stored.select(*ENTRY).where(F.lit(now_ms) - F.col("last_ms") <= retention_ms)
        rows = kept.select((F.col("place") - F.lit(BEFORE)).alias("pos"), "stable_id", *EVENT).unionByName(rows)
    f = cut(_titled(cut(_features(rows))))
    parts = connected_components(_stars(f)).select(F.col("node").alias("pos"), "component")
    every = f.join(parts.hint("merge"), "pos", "left").where("component IS NOT NULL OR pos >= 0").select(F.coalesce("component", "pos").alias("component"), *GIVEN)
    ordered = every.repartition("component").sortWithinPartitions("component", "pos")
    said = cut(ordered.mapInArrow(_replay, REPLAYED))

    changes = said.where("lifecycle <> 'ongoing'").select("pos", F.expr(f"pos div {BLOCK}").alias("block"))
    sizes = changes.groupBy("block").agg(F.count("*").alias("n"))
    offsets = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n") + F.lit(cursor)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("pos"))
    numbered = changes.withColumn("nth", nth).join(offsets, "block").select("pos", (F.col("offset") + F.col("nth")).alias("seq"))
    said = said.join(numbered.hint("merge"), "pos", "left")

    earlier = ["first_ms", "changed_ms", "update_count", "change_sequence"]
    if kept is not None:
        said = said.join(kept.select((F.col("place") - F.lit(BEFORE)).alias("life"), *earlier).hint("merge"), "life", "left")
    else:
        said = said.withColumns({c: F.lit(None).cast("long") for c in earlier})
    so_far = Window.partitionBy("life").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seq, updates = F.last("seq", ignorenulls=True).over(so_far), F.sum((F.col("lifecycle") == "updated").cast("long")).over(so_far)
    now = F.lit(now_ms).cast("long")  # a small clock would be an int
    events = cut(said.select(
        F.col("pos").alias("ord"), "slot", "stable_id", "lifecycle", F.coalesce("first_ms", now).alias("first_ms"), now.alias("last_ms"),
        F.when(seq.isNotNull(), now).otherwise(F.col("changed_ms")).alias("changed_ms"), (F.coalesce("update_count", F.lit(0)) + updates).alias("update_count"),
        F.coalesce(seq, "change_sequence").alias("change_sequence"),
    ))
    # The ledger: of each place the last event, and the places that no event met.
    last = events.groupBy("slot").agg(F.max_by(F.struct(*[c for c in events.columns if c != "slot"]), "ord").alias("e"), F.min_by("change_sequence", "ord").alias("begun"))
    place = F.when(F.col("slot") < 0, F.col("slot") + F.lit(BEFORE)).otherwise(F.col("begun")).alias("place")
    after = last.select("e.*", place).join(incoming.select(F.col("ord").cast("long").alias("ord"), *EVENT).hint("merge"), "ord").select(*ENTRY)
    if kept is not None:
        after = after.unionByName(kept.join(last.select((F.col("slot") + F.lit(BEFORE)).alias("place")).hint("merge"), "place", "left_anti").select(*ENTRY))
    top = events.agg(F.max("change_sequence")).first()[0]
    named = events.join(incoming.select(F.col("ord").cast("long").alias("ord"), F.col("id").alias("fused_id")).hint("merge"), "ord")
    return named.select("ord", "stable_id", "fused_id", "lifecycle", *earlier[:1], "last_ms", *earlier[1:]), cut(after), max(cursor, top or 0)
