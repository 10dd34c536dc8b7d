"""Lists of named entities: reading them, an index of all their names, and many lookups by exact name or part of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandline.functions.text import normalise_name

#: Columns of a list; others are ignored, absent ones are null.
FIELDS = ("id", "schema", "name", "aliases", "countries", "program_ids", "sanctions", "first_seen", "last_seen")
GRAM = 3


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def read_entities(spark: SparkSession, *paths: str) -> DataFrame:
    """Entities of CSV files with a header: ``ord, id, schema, name, aliases, countries, programs, sanctions, first_seen, last_seen``.

    Fields may be quoted and hold commas, line breaks and doubled quotes; lists are cut at semicolons.  ``ord`` follows
    the order of a file.  Rows without a name are left out; a missing id is empty, a missing schema is LegalEntity.  A file
    is read by one task, as its line breaks don't tell where rows end: a large list comes as several files.
    """
    rows = spark.read.csv(list(paths), header=True, multiLine=True, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE")
    have = {c.strip().lower(): c for c in rows.columns}
    field = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")
    said = lambda c: F.coalesce(field(c), F.lit(""))
    return rows.withColumn("ord", F.monotonically_increasing_id()).select(
        "ord", said("id").alias("id"), F.when(said("schema") == "", "LegalEntity").otherwise(field("schema")).alias("schema"), field("name").alias("name"), _listed(field("aliases")).alias("aliases"),
        _listed(field("countries")).alias("countries"), _listed(field("program_ids")).alias("programs"), said("sanctions").alias("sanctions"), field("first_seen").alias("first_seen"), field("last_seen").alias("last_seen"),
    ).where("name <> ''")


def alias_keys(entities: DataFrame) -> DataFrame:
    """``ord, id, schema, key, named``: each normalised name of each entity once; ``named`` tells names from aliases.

    Names that are empty once normalised, and null aliases, are no keys.
    """
    names = F.concat(F.array(F.struct(F.col("name").alias("text"), F.lit(True).alias("named"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("text"), F.lit(False).alias("named"))))
    each = entities.select("ord", "id", "schema", F.explode(names).alias("n")).select("ord", "id", "schema", normalise_name(F.col("n.text")).alias("key"), "n.named")
    return each.where("key <> ''").groupBy("ord", "id", "schema", "key").agg(F.bool_or("named").alias("named"))


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def _parts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``text, key``: the keys that contain a text; texts are distinct and not empty.

    An inverted index of runs of three letters: a text is looked up by its rarest run and then compared in full.
    Texts of one or two letters are runs themselves.
    """
    names = keys.select("key").distinct()
    length = F.length("text")
    asked = texts.select("text", F.explode(F.when(length < GRAM, F.array("text")).otherwise(_grams(F.col("text"), GRAM))).alias("gram"))
    sizes = [GRAM] if texts.where(length < GRAM).isEmpty() else [1, 2, GRAM]
    index = names.select("key", F.explode(F.concat(*[_grams(F.col("key"), n) for n in sizes])).alias("gram"))
    met = index.join(asked.select("gram").distinct(), "gram", "left_semi")
    common = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(common, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("text", F.col("r.gram").alias("gram"))
    return rarest.join(met, "gram").where(F.col("key").contains(F.col("text"))).select("text", "key")


def _asked(queries: DataFrame, least: int) -> DataFrame:
    return queries.where(F.length("text") >= least).withColumn("q", normalise_name(F.col("text"))).where("q <> ''")


def _first(hits: DataFrame, most: int, *order: str) -> DataFrame:
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order, "id"))).where(F.col("place") <= most)


def search(queries: DataFrame, keys: DataFrame, most: int = 50, schema: str | None = None) -> DataFrame:
    """``q, id, rank, place``: the first ``most`` entities for each distinct query text (``text``), by rank and list order.

    Ranks: 0 the name, 1 an alias, 2 part of the name, 3 part of an alias.  Null texts, texts of under four letters and
    texts that are empty once normalised find nothing.  An id that is listed twice counts once, with its best rank.  All
    entities are ranked; ``most`` is the page.
    """
    texts = _asked(queries, 4).select(F.col("q").alias("text")).distinct()
    if schema is not None:
        keys = keys.where(F.col("schema") == schema)
    hits = _parts(texts, keys).join(keys, "key")
    rank = F.when(F.col("key") == F.col("text"), 0).otherwise(2) + F.when(F.col("named"), 0).otherwise(1)
    best = hits.groupBy(F.col("text").alias("q"), "id").agg(F.min(F.struct(rank.alias("rank"), "ord")).alias("b")).select("q", "id", "b.*")
    return _first(best, most, "rank", "ord").select("q", "id", "rank", "place")


def match_edges(queries: DataFrame, keys: DataFrame, most: int = 5) -> DataFrame:
    """``entity, id, place``: edges from each ``entity`` to the entities of the list that its ``text`` names.

    The first ``most`` in list order whose name or alias is the text; only if there is none, those that contain it.  Null
    texts, texts of under three letters and those empty once normalised have no edge; repeated queries have theirs once.
    Equal texts are looked up once, so a text that a third of all rows share costs one lookup.
    """
    asked = _asked(queries, 3).select("entity", "q").distinct()
    texts = asked.select(F.col("q").alias("text")).distinct()
    exact = texts.join(keys, F.col("key") == F.col("text")).select("text", "id", "ord")
    rest = texts.join(exact.select("text").distinct(), "text", "left_anti")
    part = _parts(rest, keys).join(keys, "key").select("text", "id", "ord")
    hits = exact.unionByName(part).groupBy(F.col("text").alias("q"), "id").agg(F.min("ord").alias("ord"))
    return asked.join(_first(hits, most, "ord"), "q").select("entity", "id", "place")
