"""Classifiers and the alias search read the whole text of a document, not its beginning."""

from strandline.plans import registry


def documents(spark, path, texts):
    # doc_id is 4 modulo 9, so that the queries set nothing before the text, and lies outside of every zone.
    spark.createDataFrame([(9 * i + 4, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_words_late_in_the_text_count(spark, tmp_path):
    calm = "calm " * 100
    sf = documents(spark, tmp_path, [calm, calm + "earthquake", calm + "missile attack explosion", "earthquake"])
    category = {r.doc_id: r.category for r in registry.QUERIES["fus01_classify"](spark, sf).collect()}
    assert category[4] == "other" and category[13] == category[31] != "other" and category[22] not in ("other", category[13])
    risk = {r.doc_id: r.risk for r in registry.QUERIES["fus20_risk"](spark, sf).collect()}
    assert risk[22] > risk[4] == 1


def test_aliases_on_later_lines_and_past_160_characters_count(spark, tmp_path):
    sf = documents(spark, tmp_path, ["plain", "plain\nsecond line with worthless words", "x " * 100 + "worthless"])
    found = {r.doc_id for r in registry.QUERIES["jn06_zone_join"](spark, sf).collect() if r.zone == "horn"}
    assert {13, 22} <= found and 4 not in found
    horn = [r for r in registry.QUERIES["agg12_zone_rollup"](spark, sf).collect() if r.zone == "horn"]
    assert [r.matches for r in horn] == [len(found)]
