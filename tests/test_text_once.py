"""Word lists against whole texts: a text is lower-cased once, and prefilters lose no place."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import text


@pytest.mark.parametrize("rule", [text.classify_event, text.locate, text.risk_score])
def test_a_text_is_lowered_once(spark, rule):
    plan = spark.range(1).select(rule(F.col("id").cast("string")).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_places_are_found_as_words(spark):
    said = ["Fire in KYIV.", "kyivan rus", "St Petersburg and Moscow", "в Москвае", "Одессами", "Одессамиии", "near Saint Petersburg", "washington, d.c.", "aden", "wadena", "sana'a", "nothing", "", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r.found and r.found.label for r in rows.select("i", text.locate(F.col("s")).alias("found")).orderBy("i").collect()]
    assert got == ["Kyiv, Ukraine", None, "Moscow, Russia", "Moscow, Russia", "Odesa, Ukraine", None, "St Petersburg, Russia", "Washington, DC", "Aden, Yemen", None, "Sana'a, Yemen", None, None, None]
