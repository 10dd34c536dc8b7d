"""Prefix trie of conversations: families build their small tries, and only combined nodes are merged."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandline.llm.text import SPACED_WORD, arrow_schema
from strandline.session import cut

#: Conversations of one family share ``conv_id - conv_id % FAMILY``; of its base a conversation takes fewer turns than HEADS.
FAMILY, HEADS = 20, 4
ROOT = bytes(16)
NODES = "base long, node binary, parent binary, depth long, words long, n long, first long, has_child boolean, ends string"
SUMS = "node binary, n_children long, n_leaves long, saved_tokens long"
BATCH = 10_000


def family_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def family_nodes(base: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of a family's own trie, from its turns ``base, place, conv, key, words`` in order of place.

    Rebuilt conversations grow in step, so only the last few depths are open: memory follows the number of
    conversations in the family (39 at most), not of turns.
    """
    levels: dict[int, dict[bytes, list]] = {0: {}}
    at: dict[int, tuple[bytes, int]] = {}

    def enter(conv: int, node: bytes, parent: bytes | None, depth: int, words: int) -> None:
        own = levels.setdefault(depth, {}).get(node)
        if own is None:
            own = levels[depth][node] = [parent, words, 0, conv, False, []]
        own[2] += 1
        own[3] = min(own[3], conv)
        at[conv] = node, depth

    def step(conv: int, key: bytes, words: int) -> None:
        parent, depth = at[conv]
        levels[depth][parent][4] = True
        enter(conv, xxhash.xxh3_128_digest(parent + key), parent, depth + 1, words)

    def start(heads: dict[int, list]) -> None:
        for conv, own in heads.items():
            taken = zlib.crc32(str(conv).encode()) % HEADS
            enter(conv, ROOT, None, 0, 0)
            for key, words in heads.get(base, [])[:taken] + own[taken:]:
                step(conv, key, words)

    def end(convs) -> None:
        for conv in convs:
            node, depth = at.pop(conv)
            levels[depth][node][5].append(conv)

    def closed(below: float) -> Iterator[tuple]:
        for depth in [d for d in levels if d < below]:
            for node, (parent, words, n, first, has_child, ends) in levels.pop(depth).items():
                yield base, node, parent, depth, words, n, first, has_child, ",".join(map(str, sorted(ends))) or None

    heads: dict[int, list] = {}
    going_on: set[int] | None = None
    for place, level in groupby(rows, itemgetter(1)):
        if place < HEADS - 1:
            for _, _, conv, key, words in level:
                heads.setdefault(conv, []).append((key, words))
            continue
        if going_on is None:
            start(heads)
            going_on = set(heads)
        seen = set()
        for _, _, conv, key, words in level:
            step(conv, key, words)
            seen.add(conv)
        end(going_on - seen)
        going_on = seen
        # A conversation whose base has fewer turns than it takes is up to three turns behind.
        yield from closed(place - HEADS)
    if going_on is None:
        start(heads)
    end(list(at))
    yield from closed(float("inf"))


def family_sums(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What a family's own part of the merged nodes adds to each of its nodes, from ``base, depth, node, parent, leaf, saved`` by falling depth.

    A merged node is counted in the family of its smallest member, in whose row ``leaf`` is not null; it adds to all
    nodes above it in that family.
    """
    above: dict[bytes, list[int]] = {}
    for _, level in groupby(rows, itemgetter(1)):
        here, above = above, {}
        for node, same in groupby(level, itemgetter(2)):
            children, leaves, saved = here.get(node, (0, 0, 0))
            counted = False
            for _, _, _, parent, leaf, own in same:
                if leaf is not None:
                    leaves, saved, counted = leaves + leaf, saved + own, True
            if parent is not None and (counted or leaves or saved):
                sums = above.setdefault(parent, [0, 0, 0])
                sums[0] += counted
                sums[1] += leaves
                sums[2] += saved
            if children or leaves or saved:
                yield node, children, leaves, saved


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """SHA-256 of each node's ids, read in order family by family: the state is a digest, however many ids there are."""
    for node, own in groupby(rows, itemgetter(0)):
        state = hashlib.sha256()
        for i, (_, _, ids) in enumerate(own):
            state.update(("," * (i > 0) + ids).encode())
        yield node, state.hexdigest()


def _streamed(frame: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    schema = arrow_schema(ddl)
    return frame.mapInArrow(lambda batches: _batches(make(_rows(batches)), schema), ddl)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Every conversation is rebuilt from the first h turns of its family's base and its own turns after its first h; h is
    crc32 of its decimal id modulo four.  Returns for each node ``node`` and ``parent`` (128-bit hashes of the turns from
    the root, hexadecimal), ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Turns travel as 16-byte keys with their number of words, by family.  A family's turns are read in order of place, all its
    conversations in step, so a long conversation takes time but no memory; its nodes are combined there, and Spark
    merges only those, with partial sums.  Sums over subtrees are taken in the families again: each merged node counts in
    the family of its smallest member, whose trie has all nodes above it, and those parts are added up by node.

    A null id is no conversation, and its rows are ignored; a null role or text is empty; a null turn comes first, and
    turns that tie go by the MD5 of role and text; repeated rows are turns of their own; an empty table has no node, not even
    a root; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.regexp_count(text, F.lit(SPACED_WORD)).cast("long").alias("words"),
    ).where("conv is not null").withColumn("base", family_of(F.col("conv"))).repartition("base")
    place = F.row_number().over(W.partitionBy("base", "conv").orderBy(F.col("turn").asc_nulls_first(), "key")) - 1
    turns = turns.withColumn("place", place).select("base", "place", "conv", "key", "words").sortWithinPartitions("base", "place", "conv")
    own = cut(_streamed(turns, lambda rows: chain.from_iterable(family_nodes(base, own) for base, own in groupby(rows, itemgetter(0))), NODES))

    merged = cut(own.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.max("has_child").alias("has_child")
    ))
    counted = merged.select(family_of(F.col("conv_id")).alias("base"), "depth", "node", "parent", (~F.col("has_child")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    parts = own.select("base", "depth", "node", "parent", F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("long").alias("saved")).unionByName(counted)
    parts = parts.repartition("base").sortWithinPartitions("base", F.desc("depth"), "node")
    sums = _streamed(parts, lambda rows: chain.from_iterable(family_sums(own) for _, own in groupby(rows, itemgetter(0))), SUMS)
    sums = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    ends = own.where("ends is not null").select("node", "base", "ends").repartition("node").sortWithinPartitions("node", "base")
    ends = _streamed(ends, _digests, "node binary, ends_sha256 string")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return merged.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left").select(
        F.lower(F.hex("node")).alias("node"), F.lower(F.hex("parent")).alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
