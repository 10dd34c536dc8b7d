"""Text classification, tokens, similarity and cleaning on columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Word lists whose order and content decide the results.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "after", "into", "over", "near", "says", "said", "this", "that",
    "как", "что", "это", "для", "при", "после", "через", "или", "его", "она", "они", "уже",
    "та", "що", "після", "біля", "про",
)
CATEGORY_WORDS = (
    ("earthquake", ("earthquake", "aftershock", "землетряс", "землетрус")),
    ("volcano", ("volcano", "eruption", "вулкан", "извержен", "вивержен")),
    ("wildfire", ("wildfire", "forest fire", "bushfire", "лесной пожар", "лісова пожеж")),
    ("flood", ("flood", "flash flood", "наводнен", "повін")),
    ("weather", ("hurricane", "cyclone", "typhoon", "tornado", "storm", "ураган", "тайфун", "шторм", "циклон")),
    ("cyber", ("cyberattack", "cyber attack", "ransomware", "data breach", "ddos", "кибератак", "кібератак")),
    ("aviation", ("plane crash", "aircraft crash", "aviation incident", "airliner", "авиакатастроф", "авіакатастроф")),
    ("maritime", ("ship collision", "vessel attack", "tanker", "cargo ship", "морское судно", "корабль", "танкер")),
    ("protest", ("protest", "demonstration", "riot", "unrest", "митинг", "протест", "беспорядк", "заворушен")),
    ("political", ("coup", "election crisis", "resign", "impeach", "переворот", "выбор", "відставк")),
    ("infrastructure", ("blackout", "power outage", "grid failure", "bridge collapse", "derailment", "авария на", "отключение электр", "блэкаут")),
    ("conflict", (
        "missile", "airstrike", "shelling", "artillery", "drone attack", "military strike", "invasion", "bombardment", "explosion", "attack",
        "война", "ракет", "авиаудар", "обстрел", "беспилот", "взрыв", "війна", "обстріл", "вибух",
    )),
)
RISK_WORDS = (
    "war", "missile", "strike", "attack", "crisis", "military", "conflict", "nuclear", "invasion", "bomb", "drone", "weapon",
    "sanctions", "ceasefire", "escalation", "killed", "dead", "destroyed", "explosion", "frontline", "threat", "air raid",
    "artillery", "shelling", "evacuation", "intercepted", "airstrike", "casualties", "война", "ракет", "удар", "атак", "взрыв",
    "беспилот", "дрон", "обстрел", "погиб", "ранен", "эвакуац", "ядерн", "наступлен", "боевые действия", "воздушная тревога",
    "шахед", "війна", "вибух", "обстріл", "поранен",
)
URGENT = "breaking|urgent|developing|explosion|missile|air raid|срочно|взрыв|ракет|воздушная тревога"
# Places in the order in which they are looked for: keys, label, latitude, longitude, confidence (fixed values).
PLACES = (
    (("kyiv", "kiev", "киев", "київ"), "Kyiv, Ukraine", 50.4501, 30.5234, 0.98), (("kharkiv", "харьков", "харків"), "Kharkiv, Ukraine", 49.9935, 36.2304, 0.98),
    (("odesa", "odessa", "одесса", "одеса"), "Odesa, Ukraine", 46.4825, 30.7233, 0.98), (("dnipro", "днепр", "дніпро"), "Dnipro, Ukraine", 48.4647, 35.0462, 0.98),
    (("zaporizhzhia", "zaporozhye", "запорожье", "запоріжжя"), "Zaporizhzhia, Ukraine", 47.8388, 35.1396, 0.98), (("lviv", "львов", "львів"), "Lviv, Ukraine", 49.8397, 24.0297, 0.98),
    (("donetsk", "донецк", "донецьк"), "Donetsk", 48.0159, 37.8029, 0.96), (("crimea", "sevastopol", "крым", "крим", "севастополь"), "Crimea", 44.9521, 34.1024, 0.9),
    (("kursk", "курск"), "Kursk, Russia", 51.7304, 36.1926, 0.97), (("belgorod", "белгород"), "Belgorod, Russia", 50.5954, 36.5873, 0.97), (("moscow", "москва"), "Moscow, Russia", 55.7558, 37.6173, 0.98),
    (("st petersburg", "saint petersburg", "санкт-петербург", "петербург"), "St Petersburg, Russia", 59.9343, 30.3351, 0.98), (("gaza city", "gaza", "газа"), "Gaza", 31.5017, 34.4668, 0.94),
    (("rafah", "рафах"), "Rafah", 31.2969, 34.2435, 0.98), (("tel aviv", "тель-авив"), "Tel Aviv, Israel", 32.0853, 34.7818, 0.98), (("jerusalem", "иерусалим"), "Jerusalem", 31.7683, 35.2137, 0.98),
    (("beirut", "бейрут"), "Beirut, Lebanon", 33.8938, 35.5018, 0.98), (("damascus", "дамаск"), "Damascus, Syria", 33.5138, 36.2765, 0.98), (("aleppo", "алеппо"), "Aleppo, Syria", 36.2021, 37.1343, 0.98),
    (("tehran", "тегеран"), "Tehran, Iran", 35.6892, 51.3890, 0.98), (("isfahan", "исфахан"), "Isfahan, Iran", 32.6546, 51.6680, 0.98), (("strait of hormuz", "hormuz", "ормуз"), "Strait of Hormuz", 26.5667, 56.25, 0.92),
    (("baghdad", "багдад"), "Baghdad, Iraq", 33.3152, 44.3661, 0.98), (("erbil", "эрбиль"), "Erbil, Iraq", 36.1911, 44.0092, 0.98), (("sanaa", "sana'a", "сана"), "Sana'a, Yemen", 15.3694, 44.191, 0.98),
    (("aden", "аден"), "Aden, Yemen", 12.7855, 45.0187, 0.98), (("riyadh", "эр-рияд"), "Riyadh, Saudi Arabia", 24.7136, 46.6753, 0.98), (("doha", "доха"), "Doha, Qatar", 25.2854, 51.531, 0.98),
    (("taipei", "тайбэй"), "Taipei, Taiwan", 25.033, 121.5654, 0.98), (("beijing", "пекин"), "Beijing, China", 39.9042, 116.4074, 0.98), (("pyongyang", "пхеньян"), "Pyongyang, North Korea", 39.0392, 125.7625, 0.98),
    (("seoul", "сеул"), "Seoul, South Korea", 37.5665, 126.978, 0.98), (("tokyo", "токио"), "Tokyo, Japan", 35.6762, 139.6503, 0.98),
    (("washington dc", "washington, d.c.", "washington d.c.", "вашингтон"), "Washington, DC", 38.9072, -77.0369, 0.98), (("new york city", "new york", "нью-йорк"), "New York, US", 40.7128, -74.006, 0.96),
    (("london", "лондон"), "London, UK", 51.5072, -0.1276, 0.98), (("paris", "париж"), "Paris, France", 48.8566, 2.3522, 0.98), (("leipzig", "лейпциг"), "Leipzig, Germany", 51.3397, 12.3731, 0.98),
    (("berlin", "берлин"), "Berlin, Germany", 52.52, 13.405, 0.98), (("brussels", "брюссель"), "Brussels, Belgium", 50.8503, 4.3517, 0.98), (("warsaw", "варшава"), "Warsaw, Poland", 52.2297, 21.0122, 0.98),
    (("bucharest", "бухарест"), "Bucharest, Romania", 44.4268, 26.1025, 0.98), (("black sea", "черное море", "чёрное море"), "Black Sea", 43.0, 34.0, 0.88), (("red sea", "красное море"), "Red Sea", 20.0, 38.5, 0.88),
)
DIGEST_LABEL = r"(?iu)(?:главное\s+за|коротко\s*#|дайджест|обзор\s+новостей|news\s+(?:roundup|digest)|daily\s+briefing)"
DIGEST_ITEM = r"[♦◆🔹🔸•]|(?:^|\n)\s*(?:[-–]|\d+[.)])\s"
FAMILIES = (
    ("human-security", ("conflict", "protest", "political")), ("natural-hazard", ("earthquake", "flood", "wildfire", "volcano", "weather")),
    ("systems", ("cyber", "infrastructure")),
)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that Spark computes once: written out, it would be computed anew wherever ``f`` names it under a condition."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _any_in(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def classify_event(text: Column) -> Column:
    """The first group in order with any of its words inside the lower-cased text; else other."""
    first = lambda low: F.coalesce(*[F.when(_any_in(low, words), name) for name, words in CATEGORY_WORDS])
    return F.coalesce(_once(F.lower(text), first), F.lit("other"))


def category_family(category: Column) -> Column:
    out = category
    for name, members in FAMILIES:
        out = F.when(category.isin(*members), name).otherwise(out)
    return out


def tokens(text: Column, most: int = 32, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words among the first ``most`` that are longer than two letters and no stop words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.array_distinct(F.slice(kept, 1, most))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared words over the larger number of words; 0 if either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def risk_score(text: Column) -> Column:
    said = lambda low: reduce(lambda a, b: a + b, [F.when(low.contains(w), 1).otherwise(0) for w in RISK_WORDS])
    hits = F.coalesce(_once(F.lower(text), said), F.lit(0))
    urgent = F.when(text.rlike(f"(?iu){URGENT}"), 1).otherwise(0)
    return F.least(F.lit(10), F.greatest(F.lit(1), F.floor((1 + hits * 1.15 + urgent) + 0.5))).cast("int")


def locate(text: Column) -> Column:
    """``struct<label, lat, lng, confidence>`` of the first place any of whose keys stands in the text as words.

    A Cyrillic key may end in up to three more letters.  Only where a key stands at all is it looked at as a word.
    """
    def first(low: Column) -> Column:
        out = []
        for keys, label, lat, lng, sure in PLACES:
            words = "|".join(re.escape(k) + ("[а-яё]{0,3}" if re.search("[а-яё]", k) else "") for k in keys)
            at = F.struct(F.lit(label).alias("label"), F.lit(float(lat)).alias("lat"), F.lit(float(lng)).alias("lng"), F.lit(sure).alias("confidence"))
            out.append(F.when(_any_in(low, keys) & low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"), at))
        return F.coalesce(*out)

    return _once(F.lower(text), first)


def provider_identity(event_id: Column, source_id: Column, upstream_id: Column) -> Column:
    """The upstream id of evidence whose event id is one of its own provider's report ids; else what it was."""
    source = (
        F.when(event_id.rlike(r"^firms:(?:viirs|modis):\d+:\d+:\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("nasa-firms-"), F.split_part(event_id, F.lit(":"), F.lit(2))))
        .when(event_id.rlike("^eonet:.+"), "nasa-eonet").when(event_id.rlike("^cloudflare-outage:.+:[A-Z]{2}$"), "cloudflare-radar-outages")
    )
    return F.when(source == source_id, event_id).otherwise(upstream_id)


def is_digest(title: Column, description: Column) -> Column:
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return text.rlike(DIGEST_LABEL) & (F.regexp_count(text, F.lit(DIGEST_ITEM)) >= 2)


def decode_html(text: Column) -> Column:
    """Plain text of simple markup: breaks and block ends become line ends, tags go, common entities are decoded."""
    steps = (
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li)>", "\n"), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'),
        ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), (r"[^\S\n]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"),
    )
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, 80)


def normalise_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def canonical_url(url: Column) -> Column:
    """Without fragment; channel posts without query, preview path or closing slash. Others stay as they are."""
    plain = F.regexp_replace(url, "#.*$", "")
    channel = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\?.*$", ""), r"^https?://(?:t|telegram)\.me(?:/s(?=/))?", "https://t.me"), "/$", "")
    return F.when(~url.rlike("^https?://"), url).when(plain.rlike(r"^https?://(?:t|telegram)\.me/"), channel).otherwise(plain)


def fnv1a_base36(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII text, as base 36."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def csv_cell(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))
