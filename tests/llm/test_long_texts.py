"""Every operator on a text of over a million characters, a single word of that length, and short ones beside them."""

import random

import pytest

from strandline.llm import chat, decontam, katz, licenses, mixing, pii, quality, simhash, toxicity, warc

rng = random.Random(12)
WORDS = [f"word{i}" for i in range(5000)]
LONG = ". ".join(" ".join(rng.choices(WORDS, k=20)) for _ in range(9000)) + "."
ITEM = " ".join(f"item{i}" for i in range(15))
TEXTS = [LONG + " " + ITEM, "x" * 1_500_000, "9" * 1_500_000, "short text.", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_simhash(docs):
    got = by_id(simhash.simhash_components(docs))
    assert len(got) == 6 and got[4].component_id == got[5].component_id == 4 and got[0].component_id == 0
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {0, 1, 2, 3, 4}


def test_quality(docs):
    got = by_id(quality.quality_report(docs))
    assert got[0].n_words == 180_015 and got[0].kept and [got[i].kept for i in range(1, 6)] == [False] * 5 and got[1].word_chars == 1_500_000


def test_pii(docs):
    assert [r.spans for r in pii.find_pii(docs).collect()] == [""] * 6


@pytest.mark.parametrize("bound", [decontam.BROADCAST_CHARS, -1])
def test_decontamination(spark, docs, bound):
    bench = spark.createDataFrame([("a", ITEM), ("b", LONG[:200_000]), ("c", "y " * 20)], "item_id string, text string")
    got = by_id(decontam.contamination(docs, bench, broadcast_chars=bound))
    assert got[0].n_words == 180_015 and got[0].items == ["a", "b"] and got[0].n_hit > 20_000 and all(got[i].n_hit == 0 for i in range(1, 6))


def test_chat(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "user", "x" * 1_500_000), (1, 2, None, None), (2, 0, "system", "s")]
    got = chat.repair_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 and sum(len(r.rendered) for r in got) > len(LONG) + 1_500_000


def test_warc(spark, docs):
    got = {r.page_id: r for r in warc.archive_round_trip(spark, docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html")).collect()}
    assert len(got) == 6 and got[1].payload_bytes == 1_500_000 and got[0].payload_bytes == len(TEXTS[0])


def test_mixing(docs):
    got = by_id(mixing.mix(docs))
    assert got[0].size == 180_015 and all(got[i].taken <= 3 * got[i].size for i in got)


def test_katz(docs):
    got = by_id(katz.score_corpus(docs))
    assert got[0].n_tokens == 180_016 and got[5].n_tokens == 1 and all(r.score < 0 for r in got.values())


def test_toxicity(spark, docs):
    grades = spark.createDataFrame([(i, i % 3) for i in range(6)], "doc_id long, grade int")
    assert toxicity.toxicity(docs, grades).count() == 6


def test_licenses(docs):
    got = by_id(licenses.scan_licenses(docs))
    assert got[0].n_words == 180_015 and all(r.labels == "" for r in got.values())
