import re
from collections import Counter

from pyspark.sql import functions as F

from strandline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_brute_force(spark):
    texts = [
        None, "", " \t\n\r", "one", "a b c a b c a b c", "x y z\nx y z\n\nx y z", "é ü 𝄞 words.\n#*$%", "same " * 70,
        "a b c d a b c x " * 30, "w " * 3000 + "\x0b\x0ctail", "A b c d",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = quality.quality_report(docs).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert quality.quality_report(docs.where("false")).count() == 0


def test_lines_fail_and_documents_go(spark):
    good = "\n".join(f"Sentence {i} holds word{i} and thing{i} with plain{i} talk{i}." for i in range(12))
    few = good + "\nHome | About | Contact | Help.\nAll Rights Reserved."
    menu = "\n".join(f"item{i} | other{i} | more{i} | last{i} | end{i}" for i in range(30))
    rows = {r.doc_id: r for r in quality.quality_columns(spark.createDataFrame([(1, good), (2, few), (3, menu)], "doc_id long, text string")).where("n_words > 0").collect()}
    assert rows[1].kept and rows[1].clean_text == good and rows[1].lost_chars == 0
    assert rows[2].kept and rows[2].clean_text == good
    assert not rows[3].kept and not rows[3].base_failed
