"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandline.llm.text import arrow_schema, spaced_words
from strandline.operators.graph import connected_components
from strandline.session import cut, fresh

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: The fingerprint is a ring of so many segments of equal width.
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
#: Members of a key that are still compared pair by pair; larger groups are linked through shared neighbours.
PAIRWISE = 48


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all shingles of a text; 0 without words."""
    words = spaced_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts.tolist(), last)]
    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 14):  # bits of so many shingles at a time
        ones += np.unpackbits(raw[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint of each row's whole text as a signed 64-bit number."""
    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text.isNull(), text).alias("text_hash"), text.alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(map(fingerprint, batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"]
            )

    return kept.mapInArrow(run, f"doc_id {id_type}, text_hash bigint, fp bigint")


def near_links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """Links ``src, dst`` that join exactly the fingerprints reachable over steps of at most two bits.

    Pigeonring: if two rings of four 16-bit segments differ in at most two bits, then from some segment on every
    chain of l segments differs in at most 2l/4 bits: none in the first, at most one in the first two and in the
    first three.  So the second or the third equals as well, and (start, first segment, that segment) is an
    equi-join key of 32 bits; the whole chain condition is tested before the full distance.

    Keys of up to ``PAIRWISE`` fingerprints are compared pair by pair.  In a larger group each member goes to the
    33 points within one bit outside of the key: members at one point differ in two bits at most, two members
    that differ in two bits or fewer share a point, and each point links its members to its smallest.  So the
    rows grow with the group and not with its square, and no link between different fingerprints is lost.
    """
    one = prints.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    seg = lambda c, i: F.shiftrightunsigned(c, WIDTH * (i % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)
    keys = [
        F.struct(F.lit(i).alias("start"), F.lit(i * 4 + far).alias("kind"), (F.shiftleft(seg(F.col("fp"), i), WIDTH).bitwiseOR(seg(F.col("fp"), i + far))).alias("bits"))
        for i in range(SEGMENTS) for far in (1, 2)
    ]
    keyed = one.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("kind", "bits").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(keyed.join(sizes, ["kind", "bits"]))

    small = shared.where(F.col("members") <= PAIRWISE)
    left = small.select("kind", "bits", "start", F.col("fp").alias("src"))
    right = small.select("kind", "bits", F.col("fp").alias("dst"))
    differ = F.col("src").bitwiseXOR(F.col("dst"))
    chain = lambda n: sum((F.bit_count(F.when(F.col("start") == i, seg(differ, i + k)).otherwise(0)) for i in range(SEGMENTS) for k in range(n)), F.lit(0))
    pairs = (
        left.join(right, ["kind", "bits"]).where("src < dst")
        .where((chain(2) <= 1) & (chain(3) <= 1))
        .where(F.bit_count(differ) <= MAX_BITS).select("src", "dst")
    )

    i, far = F.col("start"), F.col("kind") - F.col("start") * 4
    free = F.array(*[F.when(~(F.lit(s) == i) & ~(F.lit(s) == (i + far) % SEGMENTS), F.lit(s)) for s in range(SEGMENTS)])
    flips = F.flatten(F.transform(F.array_compact(free), lambda s: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: s * WIDTH + k)))
    big = shared.where(F.col("members") > PAIRWISE).select("fp", F.explode(F.concat(F.array(F.lit(-1)), flips)).alias("bit")).distinct()
    point = F.when(F.col("bit") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
    ball = big.select("fp", point.alias("point"))
    centre = ball.groupBy("point").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(centre, "point").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return pairs.union(stars)


#: Near-duplicate classes take shingles of five words and this similarity.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Independent prints of a text; texts are linked by any of them.  In one print half of the pairs at the similarity itself differ in
#: more bits than the mean, so one alone would lose half; the slack is in all 128 bits, which only confirm what the first 64 find.
PRINTS, SLACK = 3, 3
#: Fingerprints of a key that one task compares; keys with more are split into blocks that meet in pairs.
HOT_KEY = 4096
#: Comparisons held at a time.
CELLS = 1 << 21


def expected_bits(similarity: float, width: int) -> int:
    """Bits in which fingerprints of two texts with this Jaccard similarity of shingles differ on average, rounded down.

    Sets with Jaccard similarity J have the cosine 2J / (1 + J), and each bit differs with the share angle / pi.
    """
    return math.floor(width * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def _mixed(lanes: np.ndarray, k: int) -> np.ndarray:
    """Lanes of 64 bits turned into those of another, independent print."""
    if k == 0:
        return lanes
    x = lanes.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * k) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, prints: int = 1) -> bytes:
    """128 majority bits for each of several independent prints, over the XXH3 hashes of a text's different shingles; zero bytes without words."""
    words = spaced_words(text)
    if not words:
        return bytes(16 * prints)
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    if len(words) <= shingle:
        raw = {digest(joined, SEED)}
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        raw = {digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[shingle - 1 :].tolist())}
    lanes = np.frombuffer(b"".join(raw), ">u8").reshape(-1, 2)
    out = []
    for k in range(prints):
        rows = _mixed(lanes, k).astype(">u8").view(np.uint8).reshape(-1, 16)
        ones = np.zeros(128, np.int64)
        for at in range(0, len(rows), 1 << 14):
            ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(rows)).tobytes())
    return b"".join(out)


class Ring:
    """64 bits as a ring of ``bits`` + 1 segments, and the keys of the chains of the first ``chain`` segments.

    Pigeonring: if two rings of m segments differ in at most ``bits`` < m bits, then from some segment on every chain
    of l segments differs in at most l * bits / m bits; so the first segment equals, and the chain of the first
    ``chain`` segments differs by one of few masks.  A fingerprint's home key is its own chain, its other keys are its
    chain under each mask whose lowest bit is 0 in it, so that of two fingerprints just one goes to the other's home.
    """

    def __init__(self, bits: int, chain: int = 2):
        m = bits + 1
        self.widths = [64 // m + (i < 64 % m) for i in range(m)]
        self.starts = np.cumsum([0, *self.widths[:-1]]).tolist()
        self.budgets = [l * bits // m for l in range(m + 1)]
        self.chain = chain = min(chain, m)
        self.masks = []
        for i in range(m):
            w = [self.widths[(i + k) % m] for k in range(chain + 1)]
            owner = [k for k in range(1, chain) for _ in range(w[k])]
            found = [(0, 0)]  # mask, lowest bit
            for n in range(1, self.budgets[chain] + 1):
                for places in combinations(range(len(owner)), n):
                    if all(sum(owner[p] <= k for p in places) <= self.budgets[k + 1] for k in range(1, chain)):
                        found.append((sum(1 << (w[0] + p) for p in places), w[0] + places[0]))
            self.masks.append(found)
        #: Bits of the chain that is tested before the full distance, one segment longer than the key.
        self.tested = min(chain + 1, m)

    def rotated(self, a: np.ndarray, i: int) -> np.ndarray:
        n = self.starts[i]
        return (a >> np.uint64(n)) | (a << np.uint64(64 - n)) if n else a

    def width(self, i: int, segments: int) -> int:
        return sum(self.widths[(i + k) % len(self.widths)] for k in range(segments))

    def low(self, i: int, segments: int) -> np.uint64:
        return np.uint64((1 << self.width(i, segments)) - 1)


KEYED = "start int, bits bigint, home boolean, a bigint, b bigint"


def _keyed(one: DataFrame, ring: Ring) -> DataFrame:
    out = arrow_schema(KEYED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy().view(np.uint64) for c in batch.columns)
            for i, masks in enumerate(ring.masks):
                own = ring.rotated(a, i) & ring.low(i, ring.chain)
                for mask, lowest in masks:
                    at = slice(None) if mask == 0 else np.flatnonzero((own >> np.uint64(lowest)) & np.uint64(1) == 0)
                    n = len(own[at])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, i, np.int32)), pa.array((own[at] ^ np.uint64(mask)).view(np.int64)), pa.array(np.full(n, mask == 0)),
                        pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)),
                    ], schema=out)

    return one.mapInArrow(run, KEYED)


def _hits(ring: Ring, i: int, home: np.ndarray, a: np.ndarray, b: np.ndarray, wide_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the budgets, each with a member at home: the longer chain, then all bits."""
    at = np.flatnonzero(home)
    low, budget = ring.low(i, ring.tested), ring.budgets[ring.tested]
    rot = ring.rotated(a, i) & low
    left, right = [], []
    step = max(1, CELLS // len(a))
    for k in range(0, len(at), step):
        rows = at[k : k + step]
        x, y = np.nonzero(np.bitwise_count(rot[rows, None] ^ rot[None, :]) <= budget)
        x = rows[x]
        keep = (~home[y] | (x < y)) & (np.bitwise_count(a[x] ^ a[y]) <= ring.budgets[-1])
        x, y = x[keep], y[keep]
        keep = np.bitwise_count(a[x] ^ a[y]).astype(np.int64) + np.bitwise_count(b[x] ^ b[y]) <= wide_bits
        x, y = x[keep], y[keep]
        if len(x) > 4 * len(a):  # many pairs: only what joins them goes on
            x, y = _stars(x, y, len(a))
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _stars(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n pairs that join the same places as the given ones."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _named(a: np.ndarray, b: np.ndarray) -> list[str]:
    return [f"{p:016x}{q:016x}" for p, q in zip(a.tolist(), b.tolist())]


def ring_links(prints: DataFrame, bits: int, wide_bits: int, chain: int | None = None, hot: int = HOT_KEY) -> DataFrame:
    """Links ``src, dst`` that join exactly the 128-bit fingerprints (columns ``a, b``) reachable over steps of at most
    ``bits`` bits in ``a`` and ``wide_bits`` in both together.  Names are 32 hex digits.

    Fingerprints that share a key meet in one task, sorted by key.  There the next longer chain is tested before the
    full distance, and where many pairs match only a star of them goes on, so that links grow with the members.  A key
    with more than ``hot`` members is split into blocks of about that size, and every pair of blocks is a key of its
    own, so that no task holds a group of unbounded size.  ``chain`` is how many segments a key has; by default it
    grows with the number of fingerprints, so that keys stay short of members.  The result doesn't depend on it.
    """
    one = cut(prints.select("a", "b").distinct())
    if chain is None:
        n = one.count()
        chain = 2 + (n > 3e7) + (n > 1e9)
    ring = Ring(bits, chain)
    keyed = _keyed(one, ring).withColumn("blocks", F.lit("0"))
    hot_keys = cut(keyed.groupBy("start", "bits").agg(F.count("*").alias("members")).where(F.col("members") > hot))
    if not hot_keys.isEmpty():
        n, own = F.ceil(F.col("members") / hot), F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("members") / hot))
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat_ws("-", F.least(own, k), F.greatest(own, k)))
        keyed = keyed.drop("blocks").join(hot_keys, ["start", "bits"], "left").select(
            "start", "bits", "home", "a", "b", F.explode(F.when(F.col("members").isNull(), F.array(F.lit("0"))).otherwise(pairs)).alias("blocks")
        )
    key = ["start", "bits", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def links(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            start, home = table["start"].to_numpy(), table["home"].to_numpy()
            a, b = (table[c].to_numpy().view(np.uint64) for c in "ab")
            homes = np.concatenate(([0], np.cumsum(home)))
            src, dst = [], []
            for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if q - p > 1 and homes[q] > homes[p]:
                    x, y = _hits(ring, int(start[p]), home[p:q], a[p:q], b[p:q], wide_bits)
                    if len(x):
                        src += _named(a[p:q][x], b[p:q][x])
                        dst += _named(a[p:q][y], b[p:q][y])
            return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not len(table):
                continue
            codes = table["blocks"].combine_chunks().dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.diff(table["start"].to_numpy()).astype(bool) | np.diff(table["bits"].to_numpy()).astype(bool) | np.diff(codes).astype(bool)) + 1
            edges = np.concatenate(([0], new))
            rest = table.slice(int(edges[-1])).combine_chunks()  # the last key may go on in the next batch
            yield links(table, edges)
        if rest is not None:
            yield links(rest, np.array([0, len(rest)]))

    met = keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "src string, dst string")
    return met.distinct()


def _wide_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, prints: int = PRINTS) -> DataFrame:
    """``doc_id, text_hash, a0, b0, a1, b1, ...``: the two halves of each of a row's prints."""
    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text.isNull(), text).alias("text_hash"), text.alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    names = [f"{half}{k}" for k in range(prints) for half in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = np.frombuffer(b"".join(wide_fingerprint(t, shingle, prints) for t in batch.column(2).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2 * prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(halves[:, i])) for i in range(2 * prints))], ["doc_id", "text_hash", *names])

    return kept.mapInArrow(run, f"doc_id {id_type}, text_hash bigint, " + ", ".join(f"{n} bigint" for n in names))


def _wide_labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, prints: int = PRINTS) -> DataFrame:
    """``doc_id, text_hash, label``: label is the smallest first print of the row's class.

    Links of further prints are told in first prints: texts of one further print stand for it by the smallest of these.
    """
    rows = cut(_wide_rows(docs, id_col, text_col, shingle, prints))
    bits, wide_bits = expected_bits(similarity, 64), expected_bits(similarity, 128) + SLACK
    name = lambda k: F.lower(F.concat(F.lpad(F.hex(f"a{k}"), 16, "0"), F.lpad(F.hex(f"b{k}"), 16, "0")))
    links = cut(ring_links(rows.select(F.col("a0").alias("a"), F.col("b0").alias("b")), bits, wide_bits))
    for k in range(1, prints):
        own = cut(ring_links(rows.select(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")), bits, wide_bits))
        told = rows.select(name(0).alias("node"), name(k).alias("own")).distinct()
        stands = cut(told.groupBy("own").agg(F.min("node").alias("node"), F.max("node").alias("other")))
        same = told.join(stands.where("node <> other").select("own", F.col("node").alias("src")), "own").where("src <> node").select("src", F.col("node").alias("dst"))
        src, dst = stands.select(F.col("own").alias("src"), F.col("node").alias("s")), stands.select(F.col("own").alias("dst"), F.col("node").alias("d"))
        links = links.union(cut(own.join(src, "src").join(dst, "dst").where("s <> d").select("s", "d").union(same)))
    linked = connected_components(links)
    named = rows.select("doc_id", "text_hash", name(0).alias("node"))
    return named.join(linked, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("label"))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, fp, label``: label is the smallest fingerprint of the row's class."""
    rows = cut(fingerprints(docs, id_col, text_col))
    linked = connected_components(near_links(rows))
    return rows.join(linked, rows["fp"] == linked["node"], "left").select(
        "doc_id", "text_hash", "fp", F.coalesce("component", "fp").alias("label")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of whole texts under linked fingerprints (two or fewer differing bits).

    Returns ``doc_id, fingerprint, component_id``, a row for every row of ``docs``: copies share a fingerprint and
    only distinct fingerprints are compared.  A null or wordless text has fingerprint zero and links like any
    other.  ``component_id`` is the smallest doc_id reachable; a null doc_id counts only where no other is there
    (then it is null).  Repeated rows stay repeated; empty tables give an empty frame; other columns are ignored.
    """
    rows = cut(_labelled(docs, id_col, text_col))
    # Materialised, so that the join shuffles both sides anew and Spark may split a class that holds many rows.
    low = cut(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return rows.join(low, "label").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Keep one row of each class: the one with the smallest doc_id (nulls last), then the smallest text hash.

    Texts are linked if any of three independent fingerprints, over shingles of ``shingle`` words, differ in no more bits than
    those of texts with the Jaccard ``similarity`` differ on average in the first 64, which pigeonring keys search, and in
    no more than ``SLACK`` bits above that average in all 128.  A class is what links reach.

    All columns stay as they are.  A repeated row stays once.  Texts without a word (null too) are one class; an empty
    table gives an empty frame.  Documents are joined with the rows that go, which are told by doc_id and text hash.
    """
    rows = cut(_wide_labelled(docs, id_col, text_col, shingle, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    # Materialised, so that the join shuffles both sides anew and Spark may split a class that holds many rows.
    keep = cut(rows.groupBy("label").agg(F.min(order).alias("keep")))
    told = cut(
        rows.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("copies")).join(keep, "label")
        .select("doc_id", "text_hash", "copies", (order == F.col("keep")).alias("stays"))
    )
    d, h = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    text = F.col(text_col).cast("string")

    def of(rows: DataFrame) -> tuple[DataFrame, object]:
        side = rows.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
        return side, F.col(id_col).eqNullSafe(side[d]) & (F.xxhash64(text.isNull(), text) == side[h])

    kept = docs.join(*of(told.where(~F.col("stays"))), "left_anti")
    repeated = told.where("stays and copies > 1")
    if repeated.isEmpty():
        return kept
    return kept.join(*of(repeated), "left_anti").unionByName(kept.join(*of(repeated), "left_semi").dropDuplicates([id_col, text_col]))
