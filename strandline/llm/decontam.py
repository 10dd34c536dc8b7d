"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.text import WordHashes, alnum_words, map_rows
from strandline.session import cut, fresh

WINDOW, GRAM = 13, 5
#: A benchmark of up to so many characters is sent to the tasks (some 35 bytes a character in a worker); a larger one is joined.
BROADCAST_CHARS = 1_500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def winnow(hashes: np.ndarray, span: int, gram: int = GRAM) -> np.ndarray:
    """For each place the smallest hash among the k-grams of the ``span`` words that begin there.

    So a span has one fingerprint, equal wherever the same words stand: every shared span is found.
    """
    k = min(gram, span)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    grams = hashes[: len(hashes) - k + 1].copy()
    for j in range(1, k):
        grams = grams * _FACTOR + hashes[j : len(hashes) - k + 1 + j]
    width, low = 1, grams
    need = span - k + 1
    while width < need:  # windows of twice the width, the last step overlapping
        step = min(width, need - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return low[:n]


class Index:
    """Benchmark windows by their words, and their fingerprints by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        hashes = WordHashes()
        #: Owners of a window are the keys of a dict, so that any number of items may have it.
        self.items: dict[bytes, dict[str, None]] = {}
        prints: dict[int, set[int]] = {}
        for item, text in items:
            words = alnum_words(text)
            span = min(window, len(words))
            if span:
                prints.setdefault(span, set()).update(winnow(hashes.of(words), span).tolist())
                for p in range(len(words) - span + 1):
                    owners = self.items.setdefault(b" ".join(words[p : p + span]), {})
                    if item is not None:
                        owners[item] = None
        self.prints = {span: np.sort(np.fromiter(x, np.uint64, len(x))) for span, x in prints.items()}


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return np.flatnonzero(ordered[at] == values)


def _measure(words: list[bytes], found: list[tuple[int, int, dict[str, None]]]) -> tuple[int, int, list[str]]:
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for place, span, _ in found:
        hit[place] += 1
        hit[place + span] -= 1
    # A window's owners are added once, however many places it has.
    for owners in {id(owners): owners for *_, owners in found}.values():
        items.update(owners)
    return len(words), int((np.cumsum(hit)[:-1] > 0).sum()), sorted(items)


def _sent(rows: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(Index(items, window))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def make():
        hashes, table, prints = WordHashes(), index.value.items, index.value.prints

        def function(doc_id, text):
            words = alnum_words(text)
            hashed = hashes.of(words)
            found = []
            for span, ordered in prints.items():
                for p in _among(winnow(hashed, span), ordered).tolist():
                    owners = table.get(b" ".join(words[p : p + span]))
                    if owners is not None:
                        found.append((p, span, owners))
            return (doc_id, *_measure(words, found))

        return function

    return map_rows(rows, make, f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>")


def _joined(rows: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark of any size: fingerprints are joined first, then the windows of documents they hit."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("text_hash", F.xxhash64(F.col("text").isNull(), "text"))

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = alnum_words(text)
                if span := min(window, len(words)):
                    prints = winnow(hashes.of(words), span).view(np.int64)
                    keys = [b" ".join(words[p : p + span]) for p in range(len(prints))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), pa.string()), pa.array([span] * len(keys), pa.int32()), pa.array(prints), pa.array(keys, pa.binary())], ["item", "span", "fp", "words"])

    windows = cut(bench.mapInArrow(item_windows, "item string, span int, fp bigint, words binary").distinct())
    spans = sorted(r.span for r in windows.select("span").distinct().collect())  # at most as many as a window has words

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
                hashed = hashes.of(alnum_words(text))
                for span in spans:
                    fp = np.unique(winnow(hashed, span)).view(np.int64)
                    if len(fp):
                        n = len(fp)
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, batch.schema.field(0).type), pa.array(np.full(n, text_hash, np.int64)), pa.array(np.full(n, span, np.int32)), pa.array(fp)], ["doc_id", "text_hash", "span", "fp"])

    prints = rows.mapInArrow(prints_of, f"doc_id {id_type}, text_hash bigint, span int, fp bigint")
    met = (
        prints.join(windows.select("span", "fp").distinct(), ["span", "fp"], "left_semi")
        .groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("span", "fp")).alias("met"))
    )
    r, m = rows.alias("r"), met.alias("m")
    texts = r.join(m, F.expr("r.doc_id <=> m.doc_id AND r.text_hash = m.text_hash")).select("r.doc_id", "r.text_hash", "r.text", "m.met").dropDuplicates(["doc_id", "text_hash"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc_id, text_hash, text, met_here in zip(*(c.to_pylist() for c in batch.columns)):
                words = alnum_words(text)
                hashed = hashes.of(words)
                for span in {x["span"] for x in met_here}:
                    ordered = np.sort(np.array([x["fp"] for x in met_here if x["span"] == span], np.int64).view(np.uint64))
                    at = _among(winnow(hashed, span), ordered).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), batch.schema.field(0).type), pa.array([text_hash] * len(at), pa.int64()), pa.array([span] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array([b" ".join(words[p : p + span]) for p in at], pa.binary())], ["doc_id", "text_hash", "span", "place", "words"])

    places = texts.mapInArrow(candidates, f"doc_id {id_type}, text_hash bigint, span int, place bigint, words binary")
    # Windows with the same owners share one set, which is joined once a document and not once a place.
    owned = windows.groupBy("span", "words").agg(F.array_sort(F.collect_set("item")).alias("owners")).withColumn("owner_set", F.xxhash64("owners"))
    owned = cut(owned)
    sets = owned.groupBy("owner_set").agg(F.first("owners").alias("owners"))
    met = cut(places.join(owned.select("span", "words", "owner_set"), ["span", "words"]).select("doc_id", "text_hash", "place", "span", "owner_set"))
    listed = met.select("doc_id", "text_hash", "owner_set").distinct().join(sets, "owner_set").select("doc_id", "text_hash", F.explode_outer("owners").alias("item"))
    items = listed.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items")).alias("i")
    spots = met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "span")).alias("places")).alias("s")
    hits = spots.join(items, F.expr("s.doc_id <=> i.doc_id AND s.text_hash = i.text_hash")).select("s.doc_id", "s.text_hash", "s.places", "i.items")
    h = hits.alias("h")
    all_rows = r.join(h, F.expr("r.doc_id <=> h.doc_id AND r.text_hash = h.text_hash"), "left").select("r.doc_id", "r.text", "h.places", "h.items")

    def make():
        def function(doc_id, text, found, items):
            words = alnum_words(text)
            n, hit, _ = _measure(words, [(x["place"], x["span"], []) for x in found or []])
            return doc_id, n, hit, items or []

        return function

    return map_rows(all_rows, make, f"doc_id {id_type}, n_words bigint, n_hit bigint, items array<string>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Words of each document inside any occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item, or all its words if it has fewer.  Windows of documents
    whose winnowing fingerprint (the smallest 5-gram hash among the window's) is also a benchmark window's are
    extended to whole windows and compared word by word, so that nothing shared is missed and no hash decides.

    Returns ``doc_id, n_words, n_hit, items, contaminated`` for each row of ``docs``; ``items`` are the sorted ids (as
    strings) of the items with an occurring window.  A null text has no words; an item with a null id can hit but
    is not listed; an item id that occurs twice stands for all its texts; repeated rows give repeated results.  An
    empty benchmark hits nothing.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    chars = bench.agg(F.coalesce(F.sum(F.length("text") + 8), F.lit(0)).alias("n")).first().n
    if chars <= broadcast_chars:
        found = _sent(rows, [tuple(r) for r in bench.collect()], window)
    else:
        found = _joined(rows, bench, window)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: what ``contamination`` finds, with the sorted item
    ids, comma-joined, as a lower-case hex SHA-256.

    Nulls, empty and very long texts, repeated rows, repeated item ids, empty tables and other columns are treated as
    there; a document without a hit has the digest of the empty string.
    """
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is not contaminated.

    Contaminated rows are joined out by id (null equals null) and text, so ids need not be unique.  A null or empty
    text stays; repeated rows stay or go together; an empty table gives an empty frame and an empty benchmark takes
    nothing; names of other columns may clash with anything.
    """
    d, h = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    text = F.col(text_col).cast("string")
    told = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text.isNull(), text).alias("hash")).alias("doc_id"), text.alias("text"))
    bad = contamination(told, benchmark, broadcast_chars=broadcast_chars).where("contaminated").select(F.col("doc_id.id").alias(d), F.col("doc_id.hash").alias(h)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(bad[d]) & (F.xxhash64(text.isNull(), text) == bad[h]), "left_anti")
