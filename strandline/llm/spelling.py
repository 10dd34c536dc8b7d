"""Spelling variants: words one edit apart, found in blocks of a forward and a reversed dictionary."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.text import arrow_schema
from strandline.session import cut

#: Shortest word, least number of occurrences, and how many times as frequent a form must be.
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many, by its hash, loses a letter (the contract's planted misspellings).
DAMAGED = 31
#: Words that a block may have before it is subdivided, and words that a task counts before it sends them on.
BLOCK, FLUSH = 512, 300_000
#: Forms grow at least tenfold at each step, so no chain has over 20 steps; doubling covers 32 in five.
DOUBLINGS = 5


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = DAMAGED) -> DataFrame:
    """``word, n`` of the runs of letters ``[A-Za-z\\u00C0-\\u00FF]`` of at least seven code points, A-Z lower-cased, that occur twice or more.

    With ``damaged`` every run whose crc32 of ``<id>:<run>`` it divides loses the code point at that number modulo its length.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{MIN_CHARS},}}")
    out = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=out)

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                # bytes.lower() changes A-Z only.
                found = Counter(pattern.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if damaged:
                    begun = zlib.crc32(f"{name}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), begun)
                        if h % damaged == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= MIN_CHARS:
                            total[word] += n
                else:
                    total.update(found)
                if len(total) >= FLUSH:
                    yield counted()
                    total.clear()
        if total:
            yield counted()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """The block of each row: what its word keeps if the edit is within ``lo`` to ``hi`` of the longer word, of ``size`` letters."""
    short = F.col("size") - F.length("word")
    left, right = F.substr("word", F.lit(1), F.col("lo")), F.substr("word", F.col("hi") - short + 1, F.col("size"))
    return rows.withColumn("block", F.concat_ws("|", "size", "lo", "hi", left, right))


def _halves(rows: DataFrame, lo, hi) -> DataFrame:
    mid = F.floor((lo + hi) / 2).cast("int")
    window = F.explode(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))).alias("w")
    return _keyed(rows.select("word", "n", "size", window).select("word", "n", "size", "w.lo", "w.hi"))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """``block, word, n, size, lo, hi``: rows such that any two words one edit apart share exactly one block that holds the place of the edit.

    In a pair the longer word has ``size`` letters, so a word stands once as the longer (or equal) and once as the shorter.
    If the edit is in the second half the first half is whole and both words stand in one block of the forward dictionary,
    else in one of the reversed dictionary.  A block of over ``most`` words is subdivided: one edit leaves a half of the
    remaining window whole too.  A window of one letter is never divided and holds at most 91 words, one a letter and the
    shorter one.
    """
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    rows = _halves(words.select("word", "n", sizes), F.lit(0), F.col("size"))
    done = []
    while True:
        large = cut(rows.where(F.col("hi") - F.col("lo") > 1).groupBy("block").agg(F.count("*").alias("held")).where(F.col("held") > most))
        if large.isEmpty():
            break
        rows = cut(rows.join(large, "block", "left"))
        done.append(rows.where("held is null").drop("held"))
        rows = _halves(rows.where("held is not null"), F.col("lo"), F.col("hi"))
    columns = ["block", "word", "n", "size", "lo", "hi"]
    found = rows.select(columns)
    for part in done:
        found = found.unionByName(part.select(columns))
    return found


def near_in_block(rows: list[tuple[str, int]], size: int, lo: int, hi: int) -> dict[str, list]:
    """For the words of a block the number of near words there and the best of them, as ``[near, -n, word]``.

    Words are verified by what is left without one letter of the window.  A pair that an inserted letter joins at several
    places (as in a run of one letter) counts at the last of them, which is the length of the common prefix.
    """
    found: dict[str, list] = {}

    def note(word: str, near: int, best: tuple[int, str]) -> None:
        own = found.get(word)
        if own is None:
            found[word] = [near, *best]
        else:
            own[0] += near
            if best < (own[1], own[2]):
                own[1:] = best

    long = [(w, n) for w, n in rows if len(w) == size]
    short = {w[lo : hi - 1]: (-n, w) for w, n in rows if len(w) < size}
    for p in range(lo, hi):
        alike = defaultdict(list)
        for w, n in long:
            alike[w[lo:p] + w[p + 1 : hi]].append((-n, w))
        for rest, group in alike.items():
            if len(group) > 1:
                group.sort()
                for x in group:
                    note(x[1], len(group) - 1, group[1] if x is group[0] else group[0])
            if (less := short.get(rest)) is not None:
                for x in group:
                    if p == size - 1 or x[1][p] != less[1][p]:
                        note(x[1], 1, less)
                        note(less[1], 1, x)
    return found


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows block by block; a block has a bounded number of words."""
    rows, out = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), []
    for _, group in groupby(rows, itemgetter(0)):
        group = list(group)
        if len(group) > 1:
            out += [(word, *near) for word, near in near_in_block([(r[1], r[2]) for r in group], *group[0][3:]).items()]
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near ones: best is the most frequent, ties to the first by code point."""
    ddl = "word string, n_near long, less long, form string"
    schema = arrow_schema(ddl)
    found = blocks(words, most).repartitionByRange("block").sortWithinPartitions("block").mapInArrow(lambda b: _scan(b, schema), ddl)
    best = F.min(F.struct("less", "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.form").alias("best"))


def spelling_groups(words: DataFrame, most: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """Every word of ``word, n`` with ``form, root, n, n_near, form_n``.

    Two words are near if exactly one code point is inserted, deleted or replaced.  The form is the near word of largest n
    (ties: first in code-point order) if that is at least ``ratio`` times the word's n, else null; the root is where the
    forms lead.  Roots are followed by doubling over words that are forms themselves, of which there are far fewer.

    ``word`` is not null and distinct; an empty table gives an empty one; other columns are ignored.
    """
    words = cut(words.select("word", "n"))
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    formed = cut(
        words.join(near_words(words, most), "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    )
    pointers = formed.where("form is not null")
    heads = pointers.select(F.col("form").alias("word")).distinct()
    # Every form with its own form, or itself at the end of a chain.
    ways = cut(heads.join(pointers.select("word", F.col("form").alias("root")), "word", "left").select("word", F.coalesce("root", "word").alias("root")))
    for _ in range(DOUBLINGS):
        if ways.where("word <> root").isEmpty():
            break
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("on"))
        further = cut(ways.join(on, "root", "left").select("word", "root", F.coalesce("on", "root").alias("on")))
        ways = further.select("word", F.col("on").alias("root"))
        if further.where("root <> on").isEmpty():
            break
    ends = cut(ways).select(F.col("word").alias("form"), "root")
    return formed.join(ends, "form", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The spelling groups of the words of all whole texts.

    Words are counted in each task first, so a frequent word sends a row a task.  A null text has no words; a null id is
    the empty string in the hash that plants misspellings; repeated rows count again; a text of any length is one row of
    Arrow data and its distinct words; an empty table gives no word; other columns are ignored.
    """
    return spelling_groups(count_words(docs))
