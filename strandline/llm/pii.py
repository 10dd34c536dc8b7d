"""Personal data: exact patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandline.llm.text import WordHashes, map_rows
from strandline.session import cut, fresh

KINDS = ("email", "ip", "card", "phone", "secret")
#: A pattern needs so many different instances of a kind, and so large a share of what stands in it.
SUPPORT, CONFIDENCE = 3, 0.8
#: Bits of the filter that keeps words in contexts of no pattern from being sent; its size is fixed, the join after it exact.
FILTER_BITS = 1 << 22

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# The lookbehind keeps a failed run from being tried again from each of its digits; a match never ends inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words of a text; a label glued to its value with an equals sign is a word of its own.
WORD = re.compile(r"""["'(<\[{]*+[A-Za-z_][A-Za-z0-9_.-]*+=(?=[^\s=])|\S+""")
DIGIT = re.compile("[0-9]")
OPENING, CLOSING = "\"'([{<", "\"')]}>.,:;!?"
IDENTIFIER = re.compile(r"(?=[^0-9]*+[0-9])[^|#$&*%<>]{6,}+\Z")
#: Seeds of the kind ``secret``: hex digits after a cue, key ids of this shape, and identifiers after these labels (fixed values).
HEX = re.compile(r"[0-9A-Fa-f]{32,}+\Z")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}\Z")
SECRET_LABELS = frozenset(("password", "passwd", "pwd", "passphrase", "api_key", "apikey", "secret_key", "access_key"))
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at  # walk left over the local part, not beyond the last match
        while start > free and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        # the next local part can't reach over this sign
        free = max(free, at + 1)
        at = text.find("@", max(at + 1, m.end() if m else 0))


def _luhn(digits: str) -> bool:
    return sum(map(int, digits[-1::-2])) % 10 == -sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]) % 10


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], set[int]]:
    """Spans by kind and start, and the starts of matches that fail their check."""
    spans, failed = [], set()
    if "@" in text:
        spans += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
            spans.append(("ip", *m.span()))
        else:
            failed.add(m.start())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                if _luhn(digits):
                    spans.append(("card", *m.span()))
                else:
                    failed.add(m.start())
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
        else:
            failed.add(m.start())
    return spans, failed


class ContextHashes(WordHashes):
    """Hashes of words in a context: without case, quotes, brackets and closing marks."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
        bare = word.lower().strip("\"'()[]{}<>,.;!?").encode("utf-8", "surrogatepass")
        self[word] = h = xxhash.xxh64_intdigest(bare, self.seed)
        return h


_LEFT, _AROUND, _LABEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def contexts(first: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Three patterns of a slot, one a row: the two words to its left, the words around it, and the word before it alone."""
    return _mixed(np.stack([first * _LEFT + before * _MIX + np.uint64(1), before * _AROUND + after * _LEFT + np.uint64(2), before * _LABEL + np.uint64(3)]))


def _secret_seed(value: str, before: str) -> bool:
    if before[-1:] in (":", "=") and (HEX.match(value) or before.strip("\"'([{<:=").lower() in SECRET_LABELS):
        return True
    return KEY_ID.match(value) is not None


class Slots:
    """The slots of one text: its words, and which of them hold a seed, an unknown identifier or a rejected value.

    A word that ends with a colon or an equals sign may be a pattern by itself (a label).
    """

    def __init__(self, text: str, hashes: ContextHashes, base: tuple[list[tuple[str, int, int]], set[int]] | None = None):
        self.spans, failed = base or base_spans(text)
        #: ``first word, word after the last, instance, role, start, end``
        self.found: list[tuple[int, int, str, str, int, int]] = []
        bare = not (self.spans or failed or DIGIT.search(text))  # then no word is an identifier, and places aren't needed
        if bare and "=" not in text:
            words, at = text.split(), []
        else:
            at = [m.span() for m in WORD.finditer(text)]
            words = [text[a:b] for a, b in at]
        n = len(words)
        h = np.zeros(n + 3, np.uint64)  # two places before the text, one after it
        h[2 : n + 2] = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        self.hashes, self.n = h, n
        self.label = np.zeros(n, bool)
        if ":" in text or "=" in text:
            self.label = np.fromiter((w[-1] in ":=" and len(w) > 2 for w in words), bool, n)
        self.taken = np.zeros(n, bool)
        if bare:
            return
        starts, ends = [a for a, _ in at], [b for _, b in at]
        for kind, a, b in self.spans:
            i, j = bisect_right(ends, a), bisect_left(starts, b)
            self.taken[i:j] = True
            self.found.append((i, j, text[a:b], kind, a, b))
        for a in failed:
            i = bisect_right(ends, a)
            if not self.taken[i]:
                self.taken[i] = True
                self.found.append((i, i + 1, "", "-", 0, 0))
        for i, word in enumerate(words):
            if DIGIT.search(word) and not self.taken[i]:
                value = word.lstrip(OPENING)
                a = starts[i] + len(word) - len(value)
                value = value.rstrip(CLOSING)
                if len(value) >= 6 and IDENTIFIER.match(value):
                    self.taken[i] = True
                    seed = _secret_seed(value, words[i - 1] if i else "")
                    self.found.append((i, i + 1, value, "secret" if seed else "?", a, a + len(value)))

    def patterns(self) -> list[list[int]]:
        """Of each slot in ``found``."""
        if not self.found:
            return []
        h, first = self.hashes, np.array([f[0] for f in self.found])
        rows = contexts(h[first], h[first + 1], h[np.array([f[1] for f in self.found]) + 2]).T.tolist()
        return [r if i and self.label[i - 1] else r[:2] for r, i in zip(rows, first.tolist())]

    def plain(self) -> np.ndarray:
        """Patterns of all other words' slots."""
        h, n = self.hashes, self.n
        left, around, label = contexts(h[:n], h[1 : n + 1], h[3 : n + 3])
        labelled = np.zeros(n, bool)
        labelled[1:] = self.label[: n - 1]
        return np.concatenate([left[~self.taken], around[~self.taken], label[~self.taken & labelled]])


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _key(instance: str) -> str:
    """An instance as a key: the text itself, or its digest if it is long."""
    return instance if len(instance) <= 64 else "#" + hashlib.sha256(instance.encode("utf-8", "surrogatepass")).hexdigest()


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
FOUND = "found array<struct<patterns:array<bigint>,instance:string,role:string,a:bigint,b:bigint>>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text.isNull(), text).alias("text_hash"), text.alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    def make():
        hashes = ContextHashes()

        def function(doc_id, text_hash, text):
            text = text or ""
            base = base_spans(text)
            n = [sum(k == kind for k, _, _ in base[0]) for kind in KINDS[:4]]
            told = _told(base[0])
            if not (base[0] or base[1] or DIGIT.search(text)):
                return doc_id, text_hash, *n, EMPTY_SHA256, told, []
            slots = Slots(text, hashes, base)
            found = [(p, _key(value), role, a, b) for p, (_, _, value, role, a, b) in zip(slots.patterns(), slots.found)]
            return doc_id, text_hash, *n, hashlib.sha256(told.encode()).hexdigest(), told, found

        return function

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return cut(map_rows(rows, make, f"doc_id {id_type}, text_hash bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, {FOUND}"))


def _filter_of(patterns: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits a pattern, made by Spark; at most FILTER_BITS / 64 rows come to the driver."""
    bits = F.explode(F.array(*[F.shiftrightunsigned("pattern", n).bitwiseAND(FILTER_BITS - 1) for n in (0, 32)]))
    words = patterns.select(bits.alias("bit")).select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("one"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for at, word in words.groupBy("at").agg(F.bit_or("one")).collect():
        out[at] = word
    return out.view(np.uint64)


def _plain_counts(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, n``: how many other words of the whole corpus stand in each of the patterns."""
    sent = rows.sparkSession.sparkContext.broadcast(_filter_of(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ones, mask = ContextHashes(), sent.value, np.int64(FILTER_BITS - 1)

        def has(bits: np.ndarray) -> np.ndarray:
            return (ones[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1

        for batch in batches:
            met = [np.zeros(0, np.int64)]
            for text in batch.column(0).to_pylist():
                p = Slots(text or "", hashes).plain()
                p = p[has(p & mask)]
                met.append(p[has((p.view(np.uint64) >> np.uint64(32)).view(np.int64) & mask)])
            pattern, n = np.unique(np.concatenate(met), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])

    counts = rows.select("text").mapInArrow(run, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    return counts.join(patterns, "pattern", "left_semi")


def bootstrap(edges: DataFrame, plain: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Score the graph of ``pattern, instance, role, n`` and return what it accepts: ``pattern, instance, kind``.

    ``role`` is the kind of a seed, ``?`` for an unknown identifier or ``-`` for a rejected value; ``plain`` (``pattern, n``)
    counts the other words that stand in a pattern.  A pattern's confidence for a kind is the mean score for it of what
    stands in the pattern and is decided (seeds, rejected values, plain words, and unknown instances once accepted), given
    ``support`` different instances of the kind; an instance's score is one minus the product of the doubts of its
    confident patterns.  Seeds keep the score 1 for their kind and 0 for others, rejected values and plain words 0.

    Accepted instances support further patterns, and so on until neither a pattern nor an instance is added.  Accepted
    patterns stay, so both sets only grow and the rounds end; a round is joins and grouped sums.
    """
    decided = edges.where("role <> '?'").select("pattern", "n").unionByName(plain.select("pattern", "n"))
    seeds = edges.where(~F.col("role").isin("?", "-")).select("pattern", "instance", "n", F.col("role").alias("kind"), F.lit(1.0).alias("score"))
    unknown = edges.where("role = '?'").select("pattern", "instance", "n")
    patterns = accepted = None
    before = (0, 0)
    while True:
        scored, total = seeds, decided
        if accepted is not None:
            taken = unknown.join(accepted, "instance")
            scored = seeds.unionByName(taken.select("pattern", "instance", "n", "kind", "score"))
            total = decided.unionByName(taken.select("pattern", "n"))
        found = (
            scored.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_distinct("instance").alias("known"))
            .where(F.col("known") >= support).join(total.groupBy("pattern").agg(F.sum("n").alias("total")), "pattern")
            .where(F.col("mass") >= confidence * F.col("total")).select("pattern", "kind", (F.col("mass") / (F.col("total") + 0.5)).alias("sure"))
        )
        patterns = cut((found if patterns is None else found.unionByName(patterns)).groupBy("pattern", "kind").agg(F.max("sure").alias("sure")))
        claims = unknown.join(patterns, "pattern")
        doubts = claims.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("sure", F.lit(0.999)))))).alias("score"))
        accepted = cut(doubts.where(F.col("score") >= confidence).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", "best.kind", "best.score"))
        sizes = patterns.count(), accepted.count()
        if sizes == before:
            break
        before = sizes
    return claims.select("pattern", "instance", "kind").join(accepted.select("instance", "kind"), ["instance", "kind"]).select("pattern", "instance", "kind")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in each row's whole text, by exact patterns and by contextual extraction.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` (of the base spans as text),
    ``spans`` (``kind:start:end`` of all spans by kind and start, comma-joined, ends exclusive, in code points) and
    ``text_hash``.  The method adds secrets (kind ``secret``: hex of 32 or more digits after a colon or equals sign, key
    ids, identifiers after a label such as ``password=``) and every identifier, a word of six or more characters with
    a digit, that stands in a high-confidence pattern: two words to the left, the words on both sides, or a label.
    Matches that failed a check are never added.  A null text is empty; a null id stays null; repeated rows give
    repeated results; an empty table gives an empty frame; a text may be of any length; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    rows = _marked(texts)
    seen = rows.select("doc_id", "text_hash", F.explode("found").alias("f")).select("doc_id", "text_hash", "f.*")
    edges = seen.select("instance", "role", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "role").agg(F.count("*").alias("n"))
    # A pattern with fewer different instances can't become confident, whatever is accepted.
    able = edges.where("role <> '-'").groupBy("pattern").agg(F.count_distinct("instance").alias("known")).where(F.col("known") >= SUPPORT).select("pattern")
    able = cut(able)
    edges = cut(edges.join(able, "pattern", "left_semi"))
    accepted = bootstrap(edges, cut(_plain_counts(texts, able)))
    unknown = seen.where("role = '?'").select("doc_id", "text_hash", "instance", "a", "b", F.explode("patterns").alias("pattern"))
    method = seen.where("role = 'secret'").select("doc_id", "text_hash", "a", "b", F.col("role").alias("kind")).unionByName(
        unknown.join(accepted, ["pattern", "instance"]).select("doc_id", "text_hash", "a", "b", "kind")
    )
    extra = method.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "a", "b")).alias("extra")).alias("x")
    joined = rows.drop("found").alias("r").join(extra, F.expr("r.doc_id <=> x.doc_id AND r.text_hash = x.text_hash"), "left").select("r.*", "x.extra")
    order = F.array(*map(F.lit, KINDS))
    part = lambda s, i: F.split_part(s, F.lit(":"), F.lit(i))
    parsed = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(part(s, 1).alias("kind"), part(s, 2).cast("long").alias("a"), part(s, 3).cast("long").alias("b")))
    ranked = F.array_sort(F.transform(F.concat(parsed, F.col("extra")), lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind"))))
    told = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    return joined.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("extra").isNull(), F.col("base")).otherwise(told).alias("spans"), "text_hash",
    )


def mask(text: str | None, spans: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans go together under the first."""
    if not text or not spans:
        return text
    out, end = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans masked in the text; other columns stay, rows without spans are as they were.

    Spans are joined by id (null equals null) and text, so ids need not be unique.  A null or empty text stays;
    repeated rows stay repeated; an empty table gives an empty frame; names of other columns may clash with anything.
    """
    i, h, s = fresh(docs, "pii_id"), fresh(docs, "pii_hash"), fresh(docs, "pii_spans")
    text = F.col(text_col).cast("string")
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))).where("spans <> ''")
    spans = found.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.max("spans").alias(s))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text.isNull(), text) == F.col(h)), "left")
    apply_mask = F.arrow_udf(lambda t, p: _mask_arrays(t, p), "string")
    masked = F.when(F.col(s).isNull(), F.col(text_col)).otherwise(apply_mask(text, F.coalesce(s, F.lit(""))))
    return joined.select(*[masked.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _mask_arrays(texts, spans):
    return pa.array(map(mask, texts.to_pylist(), spans.to_pylist()), pa.string())
