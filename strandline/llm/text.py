"""Byte-level text helpers used inside tasks.

Upper-case A-Z become a-z and nothing else changes, whatever the locale; all work is on UTF-8 bytes, where every
byte of a non-ASCII character is over 0x7F.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACED_WORD = r"[^\x20\x09-\x0D]+"

# Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing; every other byte becomes a space.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased words between the characters 0x20 and 0x09 to 0x0D (what ``bytes.split`` splits at)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


class WordHashes(dict):
    """XXH64 of words, remembered for as many words as fit in a fixed number of entries."""

    def __init__(self, seed: int = 42, room: int = 400_000):
        super().__init__()
        self.seed, self.room = seed, room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(frame: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Apply a per-row function to Arrow batches; ``make`` runs once a task and returns the function.

    Spark bounds a batch by rows and bytes, so memory follows the longest text, not the partition.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = [function(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return frame.mapInArrow(run, schema)
