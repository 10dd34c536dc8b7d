"""Katz backoff language model with Good-Turing discounts, over the whole corpus.

Counts live in tables partitioned by n-gram.  Documents are tokenised into blocks of about two million tokens; a block
asks the tables only for its distinct words and word pairs, in packed arrays by partition, and gets the whole corpus'
counts back in the same order.  So each n-gram is sent once a block however often it stands there, a hot one is at
most a number in every block, and nothing the size of the vocabulary is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.text import arrow_schema, spaced_words
from strandline.session import cut

BLOCK_TOKENS = 1 << 21
#: Tokens a partition of the count tables stands for.
PART_TOKENS = 1 << 19
#: Good-Turing discounts hold for counts up to this.
MOST_DISCOUNTED = 5
#: The token at the end of every text (no word has a line break) and the context before its first word.
END = b"\n"
BEGIN = 0


def _pack(a: np.ndarray) -> bytes:
    """Compressed bytes, all first bytes of the numbers before all second ones, so that small numbers stay small."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a step's shuffle files as soon as the step is over (each ends in the shared folder)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Discounts:
    """d[r] for counts r up to k: Good-Turing where the counts of counts allow it, else a half off every count."""

    d: list[float] = field(default_factory=lambda: [1.0] * (MOST_DISCOUNTED + 1))

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """n[r] is the number of n-grams seen r times, for r up to k + 1."""
        k = MOST_DISCOUNTED
        out = [1.0] * (k + 1)
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            gt = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
            out[r] = gt if 0 < gt < 1 else (r - 0.5) / r
        return cls(out)

    def count(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return c * np.array(self.d)[np.where(c > MOST_DISCOUNTED, 0, c)]


@dataclass
class Unigrams:
    """The lowest order: discounted shares of known tokens, the rest for any unknown one; sums to one exactly."""

    tokens: int
    types: int
    discounts: Discounts
    discounted: float

    @property
    def whole(self) -> float:
        """What shares are taken of: one more than the tokens if no mass is left over."""
        return self.tokens if self.tokens - self.discounted > 1e-9 * self.tokens and self.tokens else self.tokens + 1

    def p(self, c: np.ndarray) -> np.ndarray:
        unknown = (self.whole - self.discounted) / self.whole
        return np.where(c > 0, self.discounts.count(c) / self.whole, unknown)


BLOCK = "block bigint, docs array<{id}>, held binary, lengths binary, tokens binary, words binary, train binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held`` rows as packed blocks: documents, tokens as places in the block's words, training counts."""
    schema = BLOCK.format(id=docs.schema["doc_id"].dataType.simpleString())
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        ids, held, lengths, parts, count, number = [], [], [], [], 0, TaskContext.get().partitionId() << 24

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            out_of = np.repeat(np.array(held, bool), lengths)
            uses = np.bincount(tokens, minlength=len(place))
            order = np.argsort(-uses, kind="stable")  # common words get small numbers, which pack well
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            train = np.bincount(tokens[~out_of], minlength=len(place))[order].astype(np.int32)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in place), np.uint64, len(place))[order]
            return _rows(out, [(number, ids, _pack(np.array(held, np.uint8)), _pack(np.array(lengths, np.int32)), _pack(rank[tokens]), _pack(hashes), _pack(train))])

        for batch in batches:
            for doc_id, text, is_held in zip(*(c.to_pylist() for c in batch.columns)):
                words = spaced_words(text)
                words.append(END)
                new = set(words).difference(place)
                place.update(zip(sorted(new), range(len(place), len(place) + len(new))))
                parts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(is_held)
                lengths.append(len(words))
                count += len(words)
                if count >= BLOCK_TOKENS:
                    yield block()
                    place, ids, held, lengths, parts, count = {}, [], [], [], [], 0
                    number += 1
        if ids:
            yield block()

    return cut(docs.select("doc_id", "text", "held").mapInArrow(run, schema))


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places by partition, in order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def _split(table: pa.Table, lengths: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple]:
    ends = np.cumsum(lengths)
    for block, a, b in zip(table["block"].to_pylist(), (ends - lengths).tolist(), ends.tolist()):
        yield block, *[_pack(x[a:b]) for x in arrays]


HISTOGRAM = MOST_DISCOUNTED + 2


WORD_ASK = "part int, block bigint, places binary, words binary, train binary"
WORD_ANSWER = "block bigint, part int, places binary, counts binary, numbers binary, histogram array<bigint>"


def _word_table(blocks: DataFrame, parts: int) -> DataFrame:
    """Of each block's words in each partition the corpus count and a number that tells the word from all others.

    A row with block -1 has the partition's counts of counts, tokens, types.
    """

    schema, answers = arrow_schema(WORD_ASK), arrow_schema(WORD_ANSWER)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, train in zip(*(c.to_pylist() for c in batch.columns)):
                words, train = _unpack(words, np.uint64), _unpack(train, np.int32)
                yield _rows(schema, [(p, block, _pack(np.diff(at, prepend=0).astype(np.int32)), _pack(words[at]), _pack(train[at])) for p, at in _by_part((words % np.uint64(parts)).astype(np.int32), parts)])

    def answer(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        words = [_unpack(b, np.uint64) for b in table["words"].to_pylist()]
        lengths = np.array([len(w) for w in words])
        distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([_unpack(b, np.int32) for b in table["train"].to_pylist()])).astype(np.int64)
        histogram = [*np.bincount(np.minimum(counts, HISTOGRAM), minlength=HISTOGRAM)[:HISTOGRAM].tolist(), int(counts.sum()), int((counts > 0).sum())]
        split = _split(table, lengths, [counts[inverse], inverse.astype(np.int64)])
        rows = [(b, part, at, c, n, None) for at, (b, c, n) in zip(table["places"].to_pylist(), split)]
        return pa.Table.from_batches([_rows(answers, [*rows, (-1, part, None, None, None, histogram)])])

    asked = blocks.select("block", "words", "train").mapInArrow(ask, WORD_ASK)
    return cut(asked.repartition(_tasks(parts), "part").groupBy("part").applyInArrow(answer, WORD_ANSWER))


def _sum_histograms(answers: DataFrame, width: int) -> list[int]:
    sums = answers.where("block = -1").agg(*[F.coalesce(F.sum(F.get("histogram", F.lit(i))), F.lit(0)).alias(f"n{i}") for i in range(width)])
    return [int(x) for x in sums.first()]


def _tasks(parts: int) -> int:
    """Tasks of a shuffle: two partitions of the count tables or half a block each, whatever the size of the corpus."""
    return max(1, parts // 2)


def _gathered(answers: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """One row a block with its answers: at most one a partition of the tables and no more than the block has n-grams."""
    own = answers.where("block >= 0").select("block", F.struct("part", *columns).alias("row")).repartition(tasks, "block")
    return own.groupBy("block").agg(F.collect_list("row").alias("got"))


def _placed(got: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts and numbers of a block's words, back in the block's order; numbers begin with 1."""
    places = [np.cumsum(_unpack(g["places"], np.int32)) for g in got]
    n = sum(map(len, places))
    counts, numbers = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for g, at in zip(got, places):
        counts[at] = _unpack(g["counts"], np.int64)
        numbers[at] = _unpack(g["numbers"], np.int64) * parts + g["part"] + 1
    return counts, numbers


def _pairs(tokens: np.ndarray, lengths: np.ndarray, n_words: int) -> np.ndarray:
    """context * (n_words + 1) + token of every token; the context before the first one has place ``n_words``."""
    local = np.empty(len(tokens), np.int64)
    local[1:] = tokens[:-1]
    local[np.cumsum(lengths) - lengths] = n_words
    local *= n_words + 1
    local += tokens
    return local


def _pair_part(u: np.ndarray, v: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Pairs stand in their context's partition, those of hot contexts in partitions by both words."""
    mixed = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(hot, v, 0).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(29)) % np.uint64(parts)).astype(np.int32)


def _block_pairs(tokens, lengths, numbers, counts, tokens_in_all, parts):
    """The distinct pairs of a block: (inverse, context, word, context's place, word's place, hot, partition)."""
    distinct, inverse = np.unique(_pairs(tokens, lengths, len(numbers)), return_inverse=True)
    inverse = inverse.astype(np.int32)
    u_at, v_at = (distinct // (len(numbers) + 1)).astype(np.int32), (distinct % (len(numbers) + 1)).astype(np.int32)
    u, v = np.append(numbers, BEGIN)[u_at], numbers[v_at]
    hot = (u == BEGIN) | (np.append(counts, 0)[u_at] * 4 * parts > tokens_in_all)
    return inverse, u, v, u_at, v_at, hot, _pair_part(u, v, hot, parts)


PAIR_ASK = "part int, block bigint, u binary, v binary, n binary, c binary, hot binary"
PAIR_ANSWER = "block bigint, part int, counts binary, sums binary, mass binary, histogram array<bigint>, hot_u bigint, hot_sums array<bigint>, hot_mass double"


def _pair_table(blocks: DataFrame, words: DataFrame, unigrams: Unigrams, parts: int) -> DataFrame:
    """Of each block's pairs in each partition the corpus count, and of each of their contexts what its backoff needs.

    That is how many of its pairs are seen once, twice ... k times, and the unigram mass of the words seen after it;
    of hot contexts each partition has its part in a row with block -2.
    """

    schema, answers = arrow_schema(PAIR_ASK), arrow_schema(PAIR_ANSWER)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, lengths, tokens, got in zip(*(c.to_pylist() for c in batch.columns)):
                lengths, tokens = _unpack(lengths, np.int32), _unpack(tokens, np.int32)
                counts, numbers = _placed(got, parts)
                inverse, u, v, _, v_at, hot, part = _block_pairs(tokens, lengths, numbers, counts, unigrams.tokens, parts)
                train = np.repeat(_unpack(held, np.uint8) == 0, lengths)
                n = np.bincount(inverse, train, len(u)).astype(np.int32)
                c = counts[v_at].astype(np.int32)
                yield _rows(schema, [(p, block, *[_pack(x[at]) for x in (u, v, n, c, hot)]) for p, at in _by_part(part, parts)])

    def answer(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        u_parts = [_unpack(b, np.int64) for b in table["u"].to_pylist()]
        lengths = np.array([len(x) for x in u_parts])
        read = lambda name, kind: np.concatenate([_unpack(b, kind) for b in table[name].to_pylist()])
        u, v, n, c, hot = np.concatenate(u_parts), read("v", np.int64), read("n", np.int32), read("c", np.int32), read("hot", bool)
        order = np.lexsort((v, u))
        first = np.ones(len(u), bool)
        first[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
        pair = np.cumsum(first) - 1
        counts = np.bincount(pair, n[order]).astype(np.int64)
        histogram = np.bincount(np.minimum(counts, HISTOGRAM), minlength=HISTOGRAM)[:HISTOGRAM].tolist()
        pair_u, pair_c, seen = u[order][first], c[order][first], counts > 0
        contexts, context = np.unique(pair_u, return_inverse=True)
        sums = np.stack([np.bincount(context, counts == r, len(contexts)) for r in range(1, MOST_DISCOUNTED + 1)]).astype(np.int32)
        mass = np.bincount(context, np.where(seen, unigrams.p(pair_c.astype(np.int64)), 0.0), len(contexts))
        back_count, back_context = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
        back_count[order], back_context[order] = counts[pair], context[pair]
        rows, end = [], np.cumsum(lengths)
        for block, a, b in zip(table["block"].to_pylist(), (end - lengths).tolist(), end.tolist()):
            own = np.unique(back_context[a:b])
            rows.append((block, part, _pack(back_count[a:b]), _pack(sums[:, own]), _pack(mass[own]), None, None, None, None))
        rows.append((-1, part, None, None, None, histogram, None, None, None))
        is_hot = np.zeros(len(contexts), bool)
        is_hot[context[pair[np.flatnonzero(hot[order])]]] = True
        rows += [(-2, part, None, None, None, None, int(contexts[i]), sums[:, i].tolist(), float(mass[i])) for i in np.flatnonzero(is_hot).tolist()]
        return pa.Table.from_batches([_rows(answers, rows)])

    tasks = _tasks(parts)
    own = blocks.select("block", "held", "lengths", "tokens").repartition(tasks, "block")
    fed = own.join(_gathered(words, tasks, "places", "counts", "numbers"), "block")
    asked = fed.select("block", "held", "lengths", "tokens", "got").mapInArrow(ask, PAIR_ASK)
    return cut(asked.repartition(_tasks(parts), "part").groupBy("part").applyInArrow(answer, PAIR_ANSWER))


SCORE = "doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents with crc32(doc_id) mod 5 other than 1, and score all of them token by token.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row (see the module).
    log10 P(v|u): a pair seen in training has its discounted share of its context; another has its context's backoff
    weight times P(v); after an unseen context it is P(v); P(v) is the discounted share of v, or what is left for
    any unknown word.  Weights make every context sum to one exactly.  A null text is empty (one end token); a null
    doc_id trains; repeated rows count and score one by one; an empty table gives an empty frame.
    """
    spark: SparkSession = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    schema = SCORE.format(id=rows.schema["doc_id"].dataType.simpleString())
    with _shuffles_freed(spark):
        blocks = _blocks(rows)
    # A block is about BLOCK_TOKENS tokens, but for one very long text.
    parts = max(1, math.ceil(blocks.count() * BLOCK_TOKENS / PART_TOKENS))
    with _shuffles_freed(spark):
        words = _word_table(blocks, parts)
    seen = _sum_histograms(words, HISTOGRAM + 2)
    tokens, types = seen[HISTOGRAM], seen[HISTOGRAM + 1]
    first = Discounts.of(seen)
    taken_off = sum(r * seen[r] * (1 - first.d[r]) for r in range(1, MOST_DISCOUNTED + 1))
    unigrams = Unigrams(tokens, types, first, tokens - taken_off)
    with _shuffles_freed(spark):
        pairs = _pair_table(blocks, words, unigrams, parts)
    second = Discounts.of(_sum_histograms(pairs, HISTOGRAM))
    # A hot context has over a (4 * parts)th of all tokens, so Spark's sums are 4 * parts rows at most, of six numbers.
    in_all = [F.sum(F.get("hot_sums", F.lit(i))).alias(f"n{i}") for i in range(MOST_DISCOUNTED)]
    summed = pairs.where("block = -2").groupBy("hot_u").agg(*in_all, F.sum("hot_mass").alias("mass")).collect()
    hot = {r.hot_u: (np.array(r[1 : 1 + MOST_DISCOUNTED], np.float64), r.mass) for r in summed}
    sent = spark.sparkContext.broadcast(hot)
    lost = np.array([r * (1 - second.d[r]) for r in range(1, MOST_DISCOUNTED + 1)])
    begins = rows.where("NOT held").count()

    out = arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, is_held, lengths, local, got, got_pairs in zip(*(c.to_pylist() for c in batch.columns)):
                is_held, lengths, local = _unpack(is_held, np.uint8), _unpack(lengths, np.int32), _unpack(local, np.int32)
                counts, numbers = _placed(got, parts)
                inverse, u, _, u_at, v_at, is_hot, part = _block_pairs(local, lengths, numbers, counts, tokens, parts)
                at_part = {g["part"]: g for g in got_pairs}
                pair, gone, mass = np.zeros(len(u), np.int64), np.zeros(len(u)), np.zeros(len(u))
                for p, at in _by_part(part, parts):
                    g = at_part[p]
                    pair[at] = _unpack(g["counts"], np.int64)
                    own, where = np.unique(u[at], return_inverse=True)
                    gone[at] = (lost @ _unpack(g["sums"], np.int32).reshape(MOST_DISCOUNTED, len(own)))[where]
                    mass[at] = _unpack(g["mass"], np.float64)[where]
                for i in np.flatnonzero(is_hot).tolist():
                    sums, m = sent.value[int(u[i])]
                    gone[i], mass[i] = lost @ sums, m
                logs = _pair_logs(pair, np.append(counts, begins)[u_at], gone, mass, unigrams.p(counts)[v_at], second)
                # Looked up a token at a time only when summed; every text has a token, its end.
                starts = np.cumsum(lengths) - lengths
                known = np.add.reduceat((counts > 0)[local], starts, dtype=np.int64)
                base = np.add.reduceat(np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))[local], starts)
                sums = known, base, np.add.reduceat(logs[inverse], starts)
                yield _rows(out, [(i, bool(h), int(n), int(k), tokens, float(b), float(s)) for i, h, n, k, b, s in zip(ids, is_held, lengths, *sums)])

    tasks = _tasks(parts)
    fed = (
        blocks.select("block", "docs", "held", "lengths", "tokens").repartition(tasks, "block")
        .join(_gathered(words, tasks, "places", "counts", "numbers"), "block")
        .join(_gathered(pairs, tasks, "counts", "sums", "mass").withColumnRenamed("got", "got_pairs"), "block")
    )
    return fed.select("docs", "held", "lengths", "tokens", "got", "got_pairs").mapInArrow(score, schema)


def _pair_logs(pair, context, gone, mass, low, discounts: Discounts) -> np.ndarray:
    """log10 P(v|u) from the counts of pair and context, the context's discount and seen unigram mass, and P(v)."""
    whole = np.where(gone > 1e-12, context, context + 1.0)  # without a discount one more leaves mass for the unseen
    left = (whole - context + gone) / np.maximum(whole, 1)
    weight = np.where(context > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    p = np.where(pair > 0, discounts.count(pair) / np.maximum(whole, 1), weight * low)
    return np.log10(p)
