"""Cleaners, canonical titles, keys, ratios and hashes over string columns."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import packs
from .normalize import DIWAN, IMPORT, UPLOAD, Profile, nfkc, normalize, squeeze
from .regexjs import WS, js

# --- fixed values: ordered replacements of the cleaners (pattern, flags, replacement) ---
_ORNAMENT = r"^[\s._\-—–·•ـ]+"
DIWAN_TITLE = (
    (r"[‎‏‪-‮]", "", ""), (_ORNAMENT, "", ""), (r"^\d{3,7}[_\-\s]*", "", ""), (r"^book\s+", "i", ""), (r"^\d+[a-z]?\s+pdf\s+", "i", ""),
    (r"^كتاب\s+pdf\s+", "i", ""), (r"^pdf\s+", "i", ""), (r"^\d+\s+(?:كتاب|book)\s+", "i", ""), (r"^(?:اقرا|اقرأ)\s+اونلاين(?:\s+(?:pdf|كتاب|\d+))*\s*", "i", ""),
    (r"\s+(?:كتاب\s+)?(?:اقرا|اقرأ)\s+اونلاين.*$", "i", ""), (r"\s+كتاب\s+صي(?:غه|غة)\s+بي\s+دي\s+اف(?:\s+(?:اقرا|اقرأ)\s+اونلاين)?(?:\s+pdf)?(?:\s+\d+)?$", "i", ""),
    (r"\s+pdf\s*\d*$", "i", ""), (r"pdf$", "i", ""), (r"\s+(?:www\.)?(?:ketabypdf\.com|booksjadid\.blogspot\.com).*$", "i", ""), (r"\s+ketabypdf\.com$", "i", ""),
    (r"\s*\[[^\]]{1,80}\]\s*(?:---|–|—)\s*.*", "", ""), (r"\s+(?:pdf|word|htm|html)$", "i", ""),
)
REFINE_TITLE = (
    (r"[‎‏‪-‮]", "", ""), (_ORNAMENT, "", ""), (r"^\d{3,7}[_\-\s]*", "", ""), (r"^\d+[a-z]?\s+pdf\s+", "i", ""), (r"^كتاب\s+صيغة\s+(?:وورد|word)\s+(?:(?:ورد|word)\s+)?", "i", ""),
    (r"^كتاب\s+pdf\s+", "i", ""), (r"^pdf\s+", "i", ""), (r"^book\s+", "i", ""), (r"^\d+\s+(?:كتاب|book)\s+", "i", ""), (r"\s+(?:www\.)?(?:ketabypdf\.com|booksjadid\.blogspot\.com).*$", "i", ""),
    (r"\s+pdf\s*\d*$", "i", ""), (r"\s+(?:pdf|word|htm|html)$", "i", ""),
)
CATALOG_TITLE = ((_ORNAMENT, "", ""), (r"^\d{3,7}[_\-\s]*", "", ""), (r"^\d+\s+(?=ديوان\b)", "", ""), (r"\s*\[[^\]]{1,80}\]\s*(?:---|–|—)\s*.*", "", ""), (r"\s+(?:pdf|word|htm|html)$", "i", ""))
LITERATURE_TITLE = (
    (r"[_]+", "", " "), (r"^\s*(?:[○♣♦•·◆◇★☆▪▫]+|[-–—]+)\s*", "", ""), (r"^\s*\d{3,8}(?:\s*[_\-.:/]|\s+u200f)\s*", "i", ""), (r"^\s*[A-Za-z]{1,12}-\d{3,8}\s*", "", ""),
    (r"^\s*www\.[^\s]+\s*", "i", ""), (r"^\s*\d{1,6}\s*(?:pdf|htm|html|word|bok|book)\s+(?:كتاب\s+)?", "i", ""), (r"^\s*\d{1,5}\s+كتاب\s+(?:اقرا|اقرأ)\s+اونلاين\s+(?:pdf|htm|html|word)\s*", "i", ""),
    (r"^\s*كتاب\s+(?:اقرا|اقرأ)\s+اونلاين\s+(?:pdf|htm|html|word)\s*", "i", ""), (r"^\s*كتاب\s+(?:pdf|htm|html|word)\s+(?:اقرا|اقرأ)\s+اونلاين\s*", "i", ""),
    (r"^\s*كتاب\s+صيغة\s+(?:ويب\s+اتش\s+تي\s+ام\s*)?(?:pdf|htm|html|word|وورد|ورد|بي\s*دي\s*اف)\s*", "i", ""), (r"^\s*\d+\s*(?=[ء-غف-ي])", "", ""),
    (r"\s*\(\s*upscaled\s*\)\s*$", "i", ""), (r"^\s*\[\s*(.*?)\s*\]\s*$", "", "$1"),
)
TELEGRAM_TITLE = (
    (r"\.pdf$", "i", ""), (r"[_]+", "", " "), (r"(?:^|\s)(?:noor[ _-]?book[ _-]?com|www\.[^\s]+|https?:\/\/[^\s]+|تحميل|download)(?:\s|$)", "i", " "),
    (r"\s+", "", " "), (r"^[-–—\s❀✦•]+|[-–—\s❀✦•]+$", "", ""),
)
ARCHIVE_PREFIXES = (
    (r"[_]+", "", " "), (r"^\s*(?:\d{3,8}|\d{1,4}\s*(?:كتاب|book|bok|pdf|word|htm))\s*", "i", ""), (r"^\s*(?:كتاب|book|bok)\s+", "i", ""), (r"\s*\[\d{4,}\]\s*(?:---|–|-).*$", "", ""),
)
FORMAT_WORDS = (r"(?:^|\s)(?:اقرا اونلاين|اقرأ اونلاين|صيغة|ورد|وورد|word|pdf|htm|html|txt|text|www|بوك|bok|ويب|اتش تي ام|اكـس ام ال|اكس ام ال)(?=$|\s)", "i", " ")
FORMAT_WORDS_RHETORIC = (r"\b(?:اقرا اونلاين|اقرأ اونلاين|صيغة|ورد|word|pdf|htm|www)\b", "i", " ")
EDITION = (r"(?:\s|[-–—،:])(?:ت\.?|تحقيق|طبعه|طبعة|نشر|مراجعه|مراجعة).*", "", "")
PERSON = (('["“”]', "", ""), (r"\([^)]*\)", "", ""), (r"،?\s*\d{3,4}(?:\s*[-–]\s*\d{0,4})?\.?$", "", ""))
STOP_TOKENS = ("ديوان", "الشعر", "شعري")
#: Addresses of single posts, and the prefix of title searches.
TELEGRAM_POST = r"(?i)^https://t\.me/Arsail2020/(\d+)/?\z"
SEARCH_URL = "https://ddl.ae/search/results/1?"
TRUNCATED = r"(?:^|\s)(?:في|عن|من|على|إلى|الى|لدى|عند|دراسة|رسالة|الباب|الفصل|الجزء|القرن|كتاب)\s*$"


def replace_all(text: Column, steps: Iterable[tuple[str, str, str]]) -> Column:
    for pattern, flags, new in steps:
        text = F.regexp_replace(text, js(pattern, flags), new)
    return text


def test(text: Column, rule: tuple[str, str]) -> Column:
    """Whether a rule's pattern occurs in ``text``; false for null."""
    return F.coalesce(text.rlike(js(*rule)), F.lit(False))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_title(text: Column, steps=DIWAN_TITLE) -> Column:
    """Archive titles without ids, formats, sites and ornaments."""
    return trim(replace_all(squeeze(F.coalesce(text, F.lit(""))), steps))


def clean_catalog_title(text: Column) -> Column:
    return clean_title(text, CATALOG_TITLE)


def clean_literature_title(text: Column) -> Column:
    return squeeze(replace_all(nfkc(F.coalesce(text, F.lit(""))), LITERATURE_TITLE))


def clean_display_title(text: Column) -> Column:
    """Title lists: NFKC, underscores to spaces, one space."""
    return squeeze(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "_+", " "))


def clean_telegram_title(text: Column) -> Column:
    return trim(replace_all(F.coalesce(text, F.lit("")), TELEGRAM_TITLE))


def clean_person(text: Column) -> Column:
    return trim(replace_all(squeeze(F.coalesce(text, F.lit(""))), PERSON))


def canonical_list_title(text: Column) -> Column:
    return normalize(F.regexp_replace(F.coalesce(text, F.lit("")), "_+", " "), IMPORT)


def canonical_archive_title(text: Column, words: tuple[str, str, str] = FORMAT_WORDS) -> Column:
    return normalize(squeeze(replace_all(F.coalesce(text, F.lit("")), (*ARCHIVE_PREFIXES, words))), IMPORT)


def canonical_diwan_title(text: Column, profile: Profile = DIWAN, steps=DIWAN_TITLE) -> Column:
    return trim(replace_all(normalize(clean_title(text, steps), profile), (EDITION,)))


def canonical_person(text: Column, generic: tuple[str, str] = packs.MERGE["generic_author"]) -> Column:
    key = normalize(F.coalesce(text, F.lit("")), UPLOAD)
    return F.when(test(key, generic), F.lit("")).otherwise(key)


def tokens(normalized: Column) -> Column:
    """Distinct tokens of two letters or more, without three stop words."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_TOKENS)))


def token_overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(tokens(left), tokens(right)))


def identity(title: Column, author: Column) -> Column:
    """A poet's diwan by the poet, any other work by title and author."""
    name = F.regexp_extract(title, js(r"(?:^|\s)ديوان\s+(.+)$"), 1)
    poet = (name != "") & (author != "") & (token_overlap(name, author) >= 2)
    return F.when(poet, F.concat(F.lit("poet-diwan::"), author)).otherwise(F.concat(F.lit("work::"), title, F.lit("::"), F.coalesce(empty_to_null(author), F.lit("author-unavailable"))))


def identity_material(title: Column, author: Column) -> Column:
    return F.when(author != "", F.concat(title, F.lit("::"), author)).otherwise(title)


def title_author_key(title: Column, author: Column) -> Column:
    """``title::author``, null unless both are there."""
    return F.when((title != "") & (author != ""), F.concat(title, F.lit("::"), author))


def url_key(url: Column) -> Column:
    return F.regexp_replace(trim(F.coalesce(url, F.lit(""))), "/+$", "")


def telegram_post_key(url: Column) -> Column:
    """The number of a post in the channel's addresses, null for any other address."""
    return empty_to_null(F.regexp_extract(url_key(url), TELEGRAM_POST, 1))


def stable_id(key: Column, prefix: str = "ddl-title-", length: int = 18) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, length))


def search_url(title: Column) -> Column:
    """The search for a title, form-encoded."""
    return F.concat(F.lit(SEARCH_URL + "queries="), F.url_encode(F.concat(F.lit("or|all|"), title)))


def parse_search_url(url: Column) -> Column:
    """The title that a search address asks for, null if it is none."""
    query = F.when(url.startswith(SEARCH_URL), F.try_url_decode(F.regexp_extract(url, r"[?&]queries=([^&#]*)", 1)))
    return F.when(query.startswith("or|all|"), F.substring(query, F.lit(8), F.length(query)))


def encode_component(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def safe_path(title: Column) -> Column:
    return squeeze(F.regexp_replace(title, r'[\\/:*?"<>|]', " "))


def compact_key(title: Column) -> Column:
    return F.regexp_replace(title, WS + "+", "")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; -1 above ``most``."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over code points."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def arabic_letters(text: Column, letters: str = r"[\x{0621}-\x{063A}\x{0641}-\x{064A}]") -> Column:
    return F.regexp_count(text, F.lit(letters))


def arabic_title(text: Column) -> Column:
    """Six Arabic letters or more, and more than Latin ones."""
    return (arabic_letters(text) >= 6) & (arabic_letters(text) > F.regexp_count(text, F.lit("[A-Za-z]")))


def arabic_text(text: Column, share: float = 0.55, foreign: tuple[str, str] | None = packs.DIWAN["foreign_script"]) -> Column:
    """Three Arabic letters or more, and a share of the ASCII letters (the only ones that this test counts as visible)."""
    raw = squeeze(F.coalesce(text, F.lit("")))
    letters = arabic_letters(raw, r"[\x{0621}-\x{064A}]")
    ok = (raw != "") & (letters >= 3) & (letters / F.greatest(F.regexp_count(raw, F.lit("[A-Za-z]")), F.lit(1)) >= share)
    return ok if foreign is None else ok & ~test(raw, foreign)


def arabic_share_title(text: Column, share: float = 0.55) -> Column:
    """The same with all letters as visible ones."""
    raw = squeeze(F.coalesce(text, F.lit("")))
    letters = arabic_letters(raw, r"[\x{0621}-\x{064A}]")
    return (letters >= 3) & (letters / F.greatest(F.regexp_count(raw, F.lit(r"\p{L}")), F.lit(1)) >= share)


def any_arabic(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{0621}-\x{064A}]"), F.lit(False))


def has_word(normalized: Column, word: str) -> Column:
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(f" {word} ")


def truncated_title(title: Column) -> Column:
    t = squeeze(title)
    return (F.length(t) < 12) | test(t, (TRUNCATED, ""))


def capture_int(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def _flatten(value, joiner: str, keys: tuple[str, ...]) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return joiner.join(x for x in (_flatten(v, joiner, keys) for v in value) if x)
    if isinstance(value, dict):
        return joiner.join(x for x in (_flatten(value.get(k), joiner, keys) for k in keys) if x)
    return str(value)


def flatten_json(text: Column, joiner: str = " ", keys: tuple[str, ...] = ("text",)) -> Column:
    """JSON of any nesting (string, array, object with ``keys``) as one string."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return ""
            try:
                return _flatten(json.loads(v), joiner, keys)
            except ValueError:
                return v

        return values.map(one)

    return run(text)


def textify(values: Column) -> Column:
    """A string array joined by `` | ``, without HTML tags and no-break space entities, in single spaces."""
    joined = F.array_join(F.coalesce(values, F.array().cast("array<string>")), " | ")
    return squeeze(F.replace(F.regexp_replace(joined, "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")))


def value_list(values: Column) -> Column:
    """Trimmed, non-empty values of a string array; empty for null."""
    some = F.coalesce(values, F.array().cast("array<string>"))
    return F.filter(F.transform(some, trim), lambda v: v.isNotNull() & (v != ""))


def as_list(json_text: Column) -> Column:
    """A JSON scalar or array as an array of strings."""
    return F.when(json_text.isNull(), F.array().cast("array<string>")).when(json_text.startswith("["), F.from_json(json_text, "array<string>")).otherwise(F.array(json_text))


def shorten(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def py_nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def compile_any(patterns: Iterable[str]) -> str:
    """One alternation of several patterns."""
    return "|".join(patterns)


def catalog_identifier(text: Column) -> Column:
    """Leading catalog number of four digits or more, null if there is none."""
    return empty_to_null(F.regexp_extract(text, js(r"^(\d{4,})(?:[_\s-]+|$)"), 1))


def shown_title(title: Column) -> Column:
    """Title without its catalog number, leading zeros, underscores; the original if nothing is left."""
    out = F.regexp_replace(title, js(r"^\d{4,}[_\s-]+"), "")
    out = F.regexp_replace(out, r"^0{2,}(?=[\x{0600}-\x{06FF}])", "")
    return F.coalesce(empty_to_null(squeeze(F.regexp_replace(out, "_+", " "))), title)


def valid_pattern(pattern: str) -> bool:
    """Whether a pattern is free of what Java and ECMAScript read differently; for tests."""
    return not re.search(r"(?<!\\)\\b", pattern)
