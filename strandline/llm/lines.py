"""Line dedup: a line that several documents hold stays in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandline.session import cut

#: Shortest key, in code points, and least number of documents for which a line counts as shared.
MIN_CHARS, MIN_DOCS = 10, 2
#: Lines that a task holds before it sends them on.
FLUSH = 1 << 17
SPACES = b" \t\n\v\f\r"


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row ``id, text_key, place, h1, h2`` for each line whose key has ``min_chars`` code points, from ``id, text_key, text``.

    A key is the line without blanks at its ends and with A-Z in lower case; h1 and h2 are the halves of its 128-bit XXH3.
    """
    schema = StructType([docs.schema["id"], docs.schema["text_key"], StructField("place", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, digests = [], [], []

            def found() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=arrow)

            for row, text in enumerate(batch.column(2).to_pylist()):
                for place, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n") if text else ()):
                    key = line.strip(SPACES)
                    # A code point has four bytes at most.
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        rows.append(row)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(key))
                        if len(rows) >= FLUSH:
                            yield found()
                            rows, places, digests = [], [], []
            if rows:
                yield found()

    return docs.select("id", "text_key", "text").mapInArrow(run, schema)


def shared_keys(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The keys that at least ``min_docs`` documents hold, with the smallest document id of each (null only if there is no other).

    Two documents hold a key if its smallest and largest ids differ, which needs no list of ids; more are counted.
    Null ids are one document.
    """
    least, nulls = F.min("id"), F.max(F.col("id").isNull().cast("int"))
    if min_docs <= 2:
        several = (least != F.max("id")) | (least.isNotNull() & (nulls == 1))
    else:
        several = F.count_distinct("id") + nulls >= min_docs
    return keys.groupBy("h1", "h2").agg(least.alias("owner"), F.coalesce(several, F.lit(False)).alias("several")).where("several").drop("several")


def _without(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), places.to_pylist()):
        lines = (text or "").split("\n")
        gone = set(gone or ())
        out.append({"text": "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text or "", "n_lines": len(lines), "n_dropped": len(gone)})
    return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without the lines whose key stands in at least ``min_docs`` documents, but for those in the smallest id that holds it.

    Returns the columns of ``docs`` with the kept lines as the text, then ``n_lines`` (before dropping) and ``n_dropped``.

    Lines are read once into slim rows (id, hash of the text, place, 128-bit key).  Spark counts documents a key with partial
    sums, so a line in a third of all documents sends a row a task; the join of lines with shared keys has one row a key on
    its other side, and both sides are shuffled for it, so that AQE can split a hot key.  Places to drop come together by
    document, and only then texts move, once.

    A null text is an empty one, which has one empty line; a null id is one document, which owns a key only if no other
    holds it; rows of one id are one document, so a line in several of them stays; repeated rows lose the same lines; an
    empty table stays empty; other columns stay, but those named ``n_lines`` and ``n_dropped`` give way.
    """
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    keys = cut(line_keys(texts, min_chars))
    shared = cut(shared_keys(keys, min_docs))
    gone = keys.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("owner")))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_set("place").alias("places"))
    met = texts.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    kept = met.select("row", F.arrow_udf(_without, "text string, n_lines long, n_dropped long")("text", "places").alias("kept"))
    stay = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return kept.select(*[F.col("kept.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in stay], "kept.n_lines", "kept.n_dropped")


def line_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document, by ``drop_shared_lines``."""
    return drop_shared_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
