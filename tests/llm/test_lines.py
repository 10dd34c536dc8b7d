import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import lines


def brute(docs, least=10, most=2):
    """The rule, line by line: documents are (id, text)."""
    holders = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < least or len(holders[key(x)]) < most or i == min(holders[key(x)], key=lambda v: (v is None, v or 0))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = ["A shared line of text", "  a SHARED line of text\t", "short", "ten chars!", "nine char", "ÄÖÜ ÄÖÜ äöü", "äöü äöü äöü", "", " not a blank ", "only one has this line", "\r\x0b a shared line of text\x0c", "日本語の文字が十個あります。", "日本語は九個です。"]


def made(seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choices(LINES + [f"line number {rng.randrange(30)}"], k=rng.randrange(9)))) for i in range(60)]
    return rows + [rows[3], rows[3], (7, "another row of seven\na shared line of text"), (None, "a shared line of text\nnull one\nonly nulls hold it"), (None, "only nulls hold it"), (90, None), (91, "")]


@pytest.mark.parametrize("seed,most", [(1, 2), (2, 2), (1, 3), (2, 5)])
def test_equals_brute_force(spark, seed, most):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("row", F.lit(1))
    got = lines.drop_shared_lines(docs.repartition(5), min_docs=most)
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()]
    assert sorted(got, key=str) == brute(rows, most=most)


def test_digest_empty_and_text_ids(spark):
    assert lines.line_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([("b", "one line for all\nmine"), ("a", "ONE line for all"), ("c", "x\n\none line for all ")], "doc_id string, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_digest(docs).collect()}
    assert got == {"a": (1, 0, hashlib.sha256(b"ONE line for all").hexdigest()), "b": (2, 1, hashlib.sha256(b"mine").hexdigest()), "c": (3, 1, hashlib.sha256(b"x\n").hexdigest())}


def test_one_line_in_all_documents_and_long_texts(spark):
    long = "\n".join(f"line number {i % 70_000} of a long text" for i in range(200_000))
    rows = [(i, "the line that everyone has") for i in range(3000)] + [(5000, long), (5001, long), (5002, "y" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.line_digest(docs).collect()}
    assert got[0] == (1, 0) and all(got[i] == (1, 1) for i in range(1, 3000))
    assert got[5000] == (200_000, 0) and got[5001] == (200_000, 200_000) and got[5002] == (1, 0)


def test_small_batches_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(lines, "FLUSH", 3)
    rows = made(4)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)
