"""Queries ``opN_<name>`` over the whole tables, and the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import chat, decontam, katz, licenses, lines, mixing, pii, prefixes, quality, simhash, spelling, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_chats(_table(spark, sf_dir, "conversations"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_corpus(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = _table(spark, sf_dir, "labels").select("doc_id", toxicity.severity_grade().alias("grade"))
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), grades)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations")).drop("node", "parent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_chat": op5_chat,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_katz": op8_katz,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_lines": op11_lines,
    "op12_spelling": op12_spelling,
    "op13_prefixes": op13_prefixes,
}

_SPACED = r"[^\x20\x09-\x0D]+"
_SPACES = r"[\x20\x09-\x0D]+"

_BOILER = " OR ".join(f"contains(translate({{x}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p in quality.BOILERPLATE)
_END = r"""[.!?:;…。！？؟]["''”’»)\]]*(?:[\x20\x09-\x0D]|$)"""
_NAV = r"(?:^|[\x20\x09])[|»›>/·•]([\x20\x09]|$)"

OP2_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPACED}') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM t),
g AS (SELECT row_number() OVER () AS rid, *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
u AS (SELECT rid, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM g),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM u) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid),
f AS (SELECT g.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
  list_filter(lines, lambda x: NOT regexp_matches(x, '{_END}')
    OR (len(translate(x, '|»›>/·•', '')) < len(x) AND 4 * len(regexp_extract_all(replace(replace(x, ' ', '  '), chr(9), ' ' || chr(9)), '{_NAV}')) >= len(regexp_extract_all(x, '{_SPACED}')))
    OR (len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) > 0 AND 10 * len(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) >= len(regexp_replace(x, '{_SPACES}', '', 'g')))
    OR ({_BOILER.format(x="x")})) AS bad
  FROM g LEFT JOIN r USING (rid)),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(regexp_replace(text, '{_SPACES}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(len(regexp_replace(array_to_string(bad, chr(10)), '{_SPACES}', '', 'g')) AS BIGINT) AS lost_chars FROM f),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM b
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alnum_words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(x=f"coalesce({text}, '')")}, '{_ALNUM}')"


OP4_SQL = f"""
WITH b AS (SELECT item_id, {_alnum_words('text')} AS w FROM benchmark),
bl AS (SELECT *, least(13, len(w)) AS span FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, span, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS i FROM bl)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_alnum_words('text')} AS w FROM documents),
dw AS (SELECT rid, span, i, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT rid, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM bw) s WHERE len(w) >= span)),
hits AS (SELECT rid, dw.span, i, item FROM dw JOIN bw ON dw.span = bw.span AND dw.g = bw.g),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + span)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM m
"""

_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}', '{telling}', '{other}')" for i, (label, text, telling, other) in enumerate(licenses.TEMPLATES))
_BLANK_LINES = r"\n([\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n)+"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_alnum_words('text')} AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_PHRASES}) v(phrase, label)),
places AS (SELECT rid, label, i - 1 AS place FROM (SELECT rid, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, p) WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY rid),
t AS (SELECT id, label, list_distinct({_alnum_words('text')}) AS t, list_filter(string_split(telling, ' '), lambda x: x <> '') AS telling, list_filter(string_split(other, ' '), lambda x: x <> '') AS other
  FROM (VALUES {_TEMPLATES}) v(id, label, text, telling, other)),
l AS (SELECT rid, list_distinct({_alnum_words('block')}) AS l FROM (SELECT rid, unnest(string_split_regex(text, '{_BLANK_LINES}')) AS block FROM d)),
m AS (SELECT rid, label, max(len(list_intersect(t, l)) / CAST(len(t) AS DOUBLE)) AS share FROM l, t
  WHERE len(list_intersect(t, l)) >= ceil({licenses.THRESHOLD}e0 * len(t) - 1e-9) AND len(list_intersect(telling, l)) = len(telling) AND len(list_intersect(other, l)) = 0 GROUP BY rid, label),
labels AS (SELECT rid, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT rid, label, bool_or(base) AS base, max(share) AS share FROM
    (SELECT rid, label, true AS base, 1e0 AS share FROM places UNION ALL SELECT rid, label, false, share FROM m) GROUP BY rid, label) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid)
"""

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, {_LOWER.format(x="trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT rid, k.doc_id, line, i, s.key IS NOT NULL AND k.doc_id <> owner AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid, doc_id
"""

# crc32 of a list of bytes {x}, by a table of 256 numbers that follows from the polynomial.
_CRC_TABLE = "(SELECT list(c ORDER BY n) AS crc_of FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)))"
_CRC = "xor(list_reduce(list_prepend(4294967295, {x}), lambda c, b: xor(c >> 8, crc_of[1 + (xor(c, b) & 255)])), 4294967295)"

OP12_SQL = f"""
WITH t AS MATERIALIZED {_CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[a-z\u00c0-\u00ff]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM r),
h AS (SELECT run, n, {_CRC.format(x="bytes")} AS h FROM b, t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM c JOIN w ON c.rest = w.word UNION SELECT w.word, c.word FROM c JOIN w ON c.rest = w.word),
f AS (SELECT p.a AS word, count(*) AS n_near, arg_min(struct_pack(b := p.b, n := w.n), struct_pack(less := -w.n, b := p.b)) AS best FROM p JOIN w ON w.word = p.b GROUP BY p.a),
g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.b END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN f USING (word)),
roots AS (WITH RECURSIVE up(word, root, next) AS (SELECT word, word, form FROM g UNION ALL SELECT up.word, g.word, g.form FROM up JOIN g ON g.word = up.next) SELECT word, root FROM up WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN roots USING (word)
"""

OP13_SQL = f"""
WITH t AS MATERIALIZED {_CRC_TABLE},
k AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list(struct_pack(key := key, words := words) ORDER BY turn NULLS FIRST, key) AS turns, {_CRC.format(x="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 4 AS h FROM k, t GROUP BY conv_id, crc_of),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[:o.h], o.turns[o.h + 1:]) AS turns FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
m AS (SELECT conv_id, d, d = len(turns) AS last, array_to_string(list_transform(turns[:d], lambda x: x.key), '') AS node, CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
v AS MATERIALIZED (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY node, d),
c AS (SELECT node[:32 * (depth - 1)] AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
a AS (SELECT above AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT n_convs, words, n_children, node[:32 * unnest(range(depth + 1))] AS above FROM v LEFT JOIN c USING (node)) GROUP BY above)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN a USING (node) LEFT JOIN c USING (node) LEFT JOIN v p ON v.depth > 0 AND p.node = v.node[:32 * (v.depth - 1)]
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality": OP2_SQL, "op4_decontamination": OP4_SQL, "op6_warc": OP6_SQL, "op10_licenses": OP10_SQL, "op11_lines": OP11_SQL, "op12_spelling": OP12_SQL, "op13_prefixes": OP13_SQL,
}
