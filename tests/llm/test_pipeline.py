"""Every stage against what its operator says row by row, over all that the stage before kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontam, pii, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocab = [f"word{i}" for i in range(300)]
    bench = [(i, " ".join(rng.choices(vocab, k=20)) + ".") for i in range(3)]
    prose = lambda n: "\n".join(" ".join(rng.choices(vocab, k=12)) + "." for _ in range(n))
    rows = [(i, prose(rng.randint(6, 30)), "en", f"s{i % 4}", 0) for i in range(80)]
    rows += [(100 + i, rows[3][1], "en", "s1", 0) for i in range(4)] + [(110, rows[5][1] + "\nsome tail without an end", "en", "s2", 0)]
    rows += [(120, prose(6) + "\n" + bench[0][1], "en", "s0", 0), (121, prose(8) + "\nMail me: a.b@mail.example.com.", "en", "s3", 0)]
    rows += [(130, None, None, None, None), (131, "", "en", "s0", 0), (None, prose(9), "en", None, 0), (132, "too short.", "en", "s0", 0)]
    rows += [rows[7], rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "pii", "mixing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], sf_dir)
        assert name == "mixing" or out.columns == COLUMNS
        out = spark.createDataFrame(out.collect(), out.schema)
        frames.append(out)
    texts = [{(r.doc_id, r.text) for r in f.collect()} for f in frames]
    report = {r.doc_id: r for r in quality.quality_columns(docs).collect()}
    assert texts[1] == {(d, report[d].clean_text) for d, _ in texts[0] if report[d].kept}
    classes = simhash.simhash_components(frames[1]).collect()
    assert len(frames[2].collect()) == len({r.component_id for r in classes}) and {d for d, _ in texts[2]} == {r.component_id for r in classes}
    assert {d for d, _ in texts[2]} & {100, 101, 102, 103} == set()
    dirty = {r.doc_id for r in decontam.contamination(frames[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()}
    assert dirty == {120} and {d for d, _ in texts[3]} == {d for d, _ in texts[2]} - dirty
    spans = {r.doc_id: r.spans for r in pii.find_pii(frames[3]).collect()}
    assert texts[4] == {(d, pii.mask(t, spans[d])) for d, t in texts[3]} and any("[email]" in t for _, t in texts[4])
    assert all(r.n_chars == len(r.text) for r in frames[4].collect())
    mixed = frames[5].collect()
    assert {(r.doc_id, r.text) for r in mixed} <= texts[4] and all(0 < r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in mixed)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(mixed)


def test_extra_columns_with_clashing_names(spark, sf_dir):
    own = {"kept": "a", "n_words": "b", "clean_text": "c", "drop_id": "d", "gone_hash": "e", "text_hash": "f", "pii_spans": "g", "row": "h", "items": "i"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for c, v in own.items():
        docs = docs.withColumn(c, F.lit(v))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert rows and all(r[c] == v for r in rows for c, v in own.items()), name
        docs = spark.createDataFrame(rows, out.schema)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
