"""Mixing sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.text import SPACED_WORD
from strandline.session import cut, fresh

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 42
#: Units that one task balances together.
BLOCK = 4096
#: A table of up to so many sources is sent to the tasks; a larger one is joined.
BROADCAST_SOURCES = 100_000
EPS = 1e-9
#: Copies of a row that are numbered in one array.
RANGE = 1 << 16
#: Exchanges that a landing may make.
EXCHANGES = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, n, target`` from rows of ``source, size``.

    Sources in code-point order, null last, take the weights in turn and share the whole size by weight; what would
    go beyond ``most`` times a source's size is shared again among the others.  That stops at one level of target a
    weight: with sources ordered by their cap a weight, those before the level are capped and the rest share the
    remainder.
    """
    by_source = cut(sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("n")))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int"))
    cap = (F.col("source_size") * most).cast("double")
    up_to = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = up_to.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    ranked = (
        by_source.withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("cap_before", F.sum("cap").over(up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(rest))
    )
    # The first source whose cap a weight is at or over the level of the rest sets the level.
    settled = ranked.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level)).withColumn(
        "level", F.first("level", ignorenulls=True).over(up_to.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return settled.select("source", F.col("source_size").cast("long").alias("source_size"), "n", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1, leaving their sum and their sum weighted by size as they are.

    Three open units at a time move along the null space of the two totals, in the direction that keeps each
    unit's expectation, until one closes; at most two stay open.
    """
    p, x = p.tolist(), size.tolist()
    draws = rng.random(len(p)).tolist()
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    waiting.reverse()
    live: list[int] = []
    while True:
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        if len(live) < 3:
            if len(live) < 2 or x[live[0]] != x[live[1]]:
                break
            live_now, u = live, (1.0, -1.0)
        else:
            a, b, c = (x[i] for i in live)
            live_now = live
            u = (1.0, -1.0, 0.0) if a == b == c else (c - b, a - c, b - a)
        forth = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(live_now, u) if v)
        back = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(live_now, u) if v)
        step = forth if draws[live_now[-1]] * (forth + back) < back else -back
        draws[live_now[-1]] = draws[live_now[-1]] * 7919.0 % 1.0
        for i, v in zip(live_now, u):
            q = p[i] + step * v
            p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        live = [i for i in live if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Close the few open units so that the size comes as near as it can, the smallest change of count first.

    What error their sizes leave is then made up by exchanging taken units for units left out, a few at most.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    want, n = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - want), abs(m.bit_count() - n), m))
    p[open_] = [best >> k & 1 for k in range(len(open_))]
    short = want - float((p[open_] * size[open_]).sum())
    for _ in range(EXCHANGES):
        taken, left = np.flatnonzero(p > 0.5), np.flatnonzero(p <= 0.5)
        if abs(short) < 1 or not len(taken) or not len(left):
            break
        left = left[np.argsort(size[left], kind="stable")]
        at = np.searchsorted(size[left], size[taken] + short)
        pairs = [(out, left[k]) for shift in (-1, 0) for out, k in zip(taken, np.clip(at + shift, 0, len(left) - 1))]
        gains = np.array([size[into] - size[out] for out, into in pairs])
        k = int(np.argmin(np.abs(gains - short)))
        if abs(gains[k] - short) >= abs(short):
            break
        p[pairs[k][0]], p[pairs[k][1]] = 0.0, 1.0
        short -= gains[k]
    return p


def cube_sample(units: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Close the probability ``p`` of every unit (``source, doc_id, size, p`` and others, unchanged) to 0 or 1.

    Units fly in blocks of about ``block`` of a source; each block leaves two open at most, and those of all blocks
    of a source fly again, so each pass has a two-thousandth of the units and a source of any share of the rows
    is spread over many tasks.  The last block of a source lands.  Balanced: counts and sizes of each source.
    Blocks are dealt by all columns but ``p``: rows equal in all of them fall into one, so number them.
    """
    schema = units.schema
    names = units.columns

    def move(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "place"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, len(frame), int(frame["place"].iloc[0]) & 0x7FFFFFFF])
        size = frame["size"].to_numpy(np.float64)
        p = flight(frame["p"].to_numpy(np.float64), size, rng)
        if frame["buckets"].iloc[0] == 1:
            p = land(p, size)
        return frame.assign(p=p)[names]

    is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    closed, live = units.where(~is_open), units.where(is_open)
    round_no = 0
    while True:
        per_source = live.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / block).alias("buckets"))
        placed = (
            live.join(per_source, live["source"].eqNullSafe(per_source["of"])).drop("of")
            .withColumn("place", F.xxhash64(*[c for c in names if c != "p"], F.lit(seed + round_no)))
            .withColumn("bucket", F.pmod("place", "buckets"))
        )
        moved = cut(placed.groupBy("source", "bucket").applyInPandas(move, schema))
        closed = closed.unionByName(moved.where(~is_open))
        live = moved.where(is_open)
        round_no += 1
        if live.isEmpty():
            return closed


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """How many words the mix takes of every row: ``doc_id, size, source_size, target, copies, taken``.

    Each document of a source is due ``target / source_size`` times: its whole part for certain, and the rest with
    that probability by cube sampling balanced on words and documents of the source.  A null text has size zero and
    takes part with nothing; a null source is a source; repeated rows are drawn one by one; an empty table gives an
    empty frame.  The same rows give the same mix again, whatever their order.
    """
    return _drawn(docs, id_col, text_col, source_col, weights, most, seed).drop("text_hash")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    text_hash = F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("text_hash")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash, F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = cut(_numbered(rows))
    targets = cut(source_targets(rows, weights, most).withColumnRenamed("source", "of").drop("n"))
    side = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        rows.join(side, rows["source"].eqNullSafe(side["of"])).drop("of")
        .withColumn("whole", F.floor(due + EPS).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(due - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    )
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    drawn = cube_sample(units, seed).select("doc_id", "text_hash", "source", "size", "source_size", "target", copies)
    return drawn.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).withColumn("taken", F.col("size") * F.col("copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number ``copy`` that tells equal ones apart.

    They are counted and written out again by count, so that copies are never in one group; ranges of ``RANGE`` copies
    keep arrays short whatever the count.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    ranges = counted.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(RANGE))))
    return ranges.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + RANGE, "rows") - 1))).drop("rows", "first")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``size, source_size, target, copies, taken``.

    Existing columns of these names are replaced.  Rows of the same id, text and source stay once, with the copies of all.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    drawn = _drawn(docs, id_col, text_col, source_col, weights, most, seed)
    d, h, o, n = (fresh(docs, f"mix_{x}") for x in ("id", "hash", "source", "rows"))
    taken = cut(
        drawn.groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("source").alias(o))
        .agg(*[F.max(c).alias(c) for c in own[:3]], *[F.sum(c).alias(c) for c in own[3:]], F.count("*").alias(n)).where("copies > 0")
    )
    kept = docs.drop(*[c for c in docs.columns if c.lower() in own])
    same = (
        F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text_col).isNull(), F.col(text_col)) == F.col(h))
        & F.col(source_col).cast("string").eqNullSafe(F.col(o))
    )
    out = kept.join(taken, same)
    if not taken.where(F.col(n) > 1).isEmpty():
        out = out.dropDuplicates([d, h, o])
    return out.select(*kept.columns, *own)
