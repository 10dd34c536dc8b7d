"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.text import SPACED_WORD, lower_ascii
from strandline.session import fresh

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document goes if the lines that fail hold more than this percentage of its word characters.
MAX_LOST_PERCENT = 50
#: A sentence ends somewhere in the line: one of these, closing quotes and brackets aside, before a space or the end.
SENTENCE_END = r"""[.!?:;…。！？؟]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""
#: Separators between the entries of menus and breadcrumbs, each standing alone (fixed values).
SEPARATORS = "|»›>/·•"
NAVIGATION = rf"(?:^|[\x20\x09])[{SEPARATORS}](?=[\x20\x09]|$)"
#: Phrases of page furniture in English, German, French and Spanish (fixed values).
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "subscribe to our newsletter", "sign in to your account", "skip to content",
    "skip to main content", "share on facebook", "share on twitter", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "nutzungsbedingungen", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "mentions légales", "politique de confidentialité", "aller au contenu", "abonnez-vous à notre newsletter",
    "todos los derechos reservados", "aceptar cookies", "aviso legal", "política de privacidad", "ir al contenido", "suscríbete a nuestro boletín",
)
BASE = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"


def _has(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")) < F.length(text)


def _furniture(text: Column) -> Column:
    low = lower_ascii(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in BOILERPLATE])


def _fails(line: Column, menus: Column, symbols: Column, furniture: Column) -> Column:
    """A line fails without any end of a sentence, as a menu, as mostly symbols, or as page furniture.

    The last three are looked at only in texts that hold such characters or phrases at all.
    """
    entries, words = F.regexp_count(line, F.lit(NAVIGATION)), F.regexp_count(line, F.lit(SPACED_WORD))
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    return (
        ~line.rlike(SENTENCE_END)
        | (menus & _has(line, SEPARATORS) & (entries * 4 >= words))
        | (symbols & (marks * 10 >= F.length(F.regexp_replace(line, SPACES, ""))))
        | (furniture & _furniture(line))
    )


def quality_columns(docs: DataFrame, text_col: str = "text", clean_text: bool = True) -> DataFrame:
    """Add the measures and verdicts of every row's whole text to ``docs``.

    New columns: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``lost_chars`` (long: word
    characters of the lines that fail), ``base_failed, kept`` (boolean) and, if asked for, ``clean_text`` (the text
    without the lines that fail; blank lines stay).  An existing column of such a name is replaced.  A null text
    counts as empty: all counts are zero, it is base-failed and not kept.  Repeated rows give repeated results, an
    empty table an empty one.

    Windows of three words are found twice by sorting their 64-bit hashes within the text, n log n for any length.
    The measures leave through ``inline``, so that a filter on them is not pushed below and computed anew.
    """
    t, w, lines, judged, hashes, grams, twice, menus, marks, furniture = (
        fresh(docs, f"q_{n}") for n in ("text", "words", "lines", "judged", "hashes", "grams", "twice", "menus", "marks", "furniture")
    )
    fails = lambda line: _fails(line, F.col(menus), F.col(marks) > 0, F.col(furniture))
    n = F.size(w)
    keep = [c for c in docs.columns if c.lower() not in {*BASE, "lost_chars", "base_failed", "kept", "clean_text"}]
    out = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(t))
    out = out.withColumns({
        w: F.array_remove(F.split(t, SPACES), ""),
        menus: _has(F.col(t), SEPARATORS),
        marks: F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, "")),
        furniture: _furniture(F.col(t)),
    })
    out = out.withColumn(hashes, F.when(n >= 3, F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    )))
    out = out.withColumn(grams, F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ))
    same = lambda x, k: F.coalesce(F.get(grams, k)["h"] == x["h"], F.lit(False))
    out = out.withColumn(twice, F.sort_array(F.transform(F.filter(grams, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # Every line is judged once; ``bad`` is null for lines without a word.
    out = out.withColumn(judged, F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), F.when(x.rlike(SPACED_WORD), fails(x)).alias("bad"))))
    out = out.withColumn(lines, F.transform(F.filter(judged, lambda x: x["bad"].isNotNull()), lambda x: x["line"]))
    bad = F.transform(F.filter(judged, lambda x: F.coalesce(x["bad"], F.lit(False))), lambda x: x["line"])
    covered = F.aggregate(
        F.transform(twice, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(twice, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    chars = lambda c: F.length(F.regexp_replace(c, SPACES, "")).cast("long")
    measures = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.col(marks).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "lost_chars": chars(F.array_join(bad, "\n")),
    }
    if clean_text:
        cleaned = F.array_join(F.transform(F.filter(judged, lambda x: ~F.coalesce(x["bad"], F.lit(False))), lambda x: x["line"]), "\n")
        measures["clean_text"] = F.when(F.size(bad) == 0, F.col(t)).otherwise(cleaned)
    out = out.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in measures.items()]))))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measures and the verdicts, a row for each row of ``docs``.

    Null and empty texts, repeated rows and empty tables are treated as in ``quality_columns``; a null id stays null;
    columns other than the two named are ignored, whatever their names; a text may be of any length.
    """
    rows = quality_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), clean_text=False)
    return rows.select("doc_id", *BASE, "lost_chars", "base_failed", "kept")
