"""Row predicates of the catalog, as boolean columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.normalize import SEARCH, py_normalize
from ..functions.regexjs import js
from ..functions.text import TELEGRAM_POST, arabic_text, test, value_list
from ..schema import ARCHIVE_SOURCE

ALL = "all"
# --- fixed values: signals, tags and sources that mark kinds of records ---
DIWAN_SIGNALS = ("سجل ديوان موثّق", "سجل ديوان مستورد ومُصنّف")
POEM_SOURCE = "المنظومات العلمية"
PRIORITY_COUNTRY = "المملكة العربية السعودية"
DEFAULT_TITLE = "معلقة"
STAT_TAGS = {"linguistics": ("نحو", "صرف", "دراسات لغوية"), "lexicon-literature-rhetoric": ("معجم لغوي", "شعر وأدب", "بلاغة")}
LANGUAGE_VALUES = ("ara", "arabic")
DIWAN_START = r"^ديوان\s+"
NOT_ALONE = r"[:؛،]|(دراسة|شرح|تحقيق|فهرس|مجموع|مختارات|رسالة|اثر|قضية|نقد|شعر|شعرية|ديوانين|دواوين|رؤية|تشكيل|تحليل|قراءة)"
PART = r"(?:^|\s)(?:الجزء|المجلد(?:ين)?|ج|مجلد(?:ين)?|part|volume)(?:\s|$)|^\d{1,3}\s+|(?:مختارات|مجموعه|منتخبات|مختار|اعمال\s+شعريه\s+كامله|الاعمال\s+الشعريه\s+الكامله)(?:\s|$)"


def not_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_standalone_diwan(signals: Iterable[str] = DIWAN_SIGNALS) -> Column:
    return not_null((F.col("primaryCategory") == "diwans") & F.arrays_overlap(F.col("matchEvidence.strongSignals"), F.array(*map(F.lit, signals))))


def is_scientific_poem(source: str = POEM_SOURCE) -> Column:
    return not_null((F.col("primaryCategory") == "scientific_poems") | ((F.col("primaryCategory") == "diwans") & (F.col("source") == source)))


def is_poetry_diwan() -> Column:
    return is_standalone_diwan() & ~is_scientific_poem()


def is_classical_book() -> Column:
    return not_null((F.col("source") == ARCHIVE_SOURCE) & F.col("primaryCategory").isin("references", "dictionaries"))


def in_list(column: str, values: Iterable) -> Column:
    return not_null(F.col(column).isin(*values))


def keep_listed(df: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the first column of ``listed``; its size decides how it is joined."""
    key = listed.select(F.col(listed.columns[0]).alias("_listed")).distinct()
    return df.join(key, F.col(column) == F.col("_listed"), "left_semi")


def category(name: str, bilingual_ids: Iterable[str] = ()) -> Column:
    """The category buttons: all rows, two derived kinds, a list of ids, or the stored category."""
    if name == ALL:
        return F.lit(True)
    if name == "diwans":
        return is_poetry_diwan()
    if name == "scientific_poems":
        return is_scientific_poem()
    if name == "bilingual_dictionaries":
        return in_list("id", bilingual_ids) if bilingual_ids else F.lit(False)
    return not_null(F.col("primaryCategory") == name)


def equals_or_all(column: str, value: str) -> Column:
    return F.lit(True) if value == ALL else not_null(F.col(column) == value)


def tokens_and(haystack: Column, query: str, profile=SEARCH) -> Column:
    """Every token of the normalised query is a substring of the normalised haystack; an empty query holds.

    The haystack is the one element of an array, so that it is computed once for all tokens.
    """
    words = [t for t in (py_normalize(query, profile) or "").split(" ") if t]

    def holds(key: Column) -> Column:
        found = key.contains(words[0])
        for word in words[1:]:
            found = found & key.contains(word)
        return found

    return not_null(F.exists(F.array(haystack), holds)) if words else F.lit(True)


def default_view(title_key: Column, word: str = DEFAULT_TITLE) -> Column:
    return not_null(title_key.contains(py_normalize(word, SEARCH)))


def stat(name: str) -> Column:
    """The four statistic filters."""
    if name == ALL:
        return F.lit(True)
    if name in STAT_TAGS:
        return any_tag(STAT_TAGS[name])
    return is_standalone_diwan() | is_scientific_poem()


def any_tag(tags: Iterable[str], column: str = "tags") -> Column:
    return not_null(F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags))))


def facets(chosen: Mapping[str, str]) -> Column:
    """AND of facet equalities, each with its wildcard."""
    out = F.lit(True)
    for column, value in chosen.items():
        out = out & equals_or_all(column, value)
    return out


def all_arabic_languages(languages: Column, rule=packs.LITERATURE["arabic_language"]) -> Column:
    """At least one value, and all name Arabic."""
    some = value_list(languages)
    return (F.size(some) > 0) & F.forall(some, lambda v: v.rlike(js(*rule)))


def any_other_language(languages: Column, rule=packs.LITERATURE["non_arabic_language"]) -> Column:
    return F.exists(value_list(languages), lambda v: v.rlike(js(*rule)))


def record_is_arabic(languages: Column, values: Iterable[str] = LANGUAGE_VALUES) -> Column:
    return F.exists(value_list(languages), lambda v: F.lower(v).isin(*values))


def arabic_proof(languages: Column, context: Column) -> Column:
    return record_is_arabic(languages) | arabic_text(context)


def is_texts(mediatype: Column) -> Column:
    return not_null(mediatype == "texts")


def is_archive_details(url: Column) -> Column:
    return not_null(url.rlike(r"(?i)^https://archive\.org/details/"))


def is_telegram_post(url: Column) -> Column:
    return not_null(F.trim(url).rlike(TELEGRAM_POST))


def is_pdf_message(kind: Column, mime: Column, name: Column) -> Column:
    return not_null(kind == "message") & (not_null(mime == "application/pdf") | not_null(name.rlike(r"(?i)\.pdf\z")))


def standalone_diwan_title(title: Column) -> Column:
    """Starts with the word for a diwan, without separators or words of studies."""
    return test(title, (DIWAN_START, "")) & ~test(title, (NOT_ALONE, ""))


def part_of_collection(key: Column) -> Column:
    """A volume, a numbered part or a selection rather than an independent collection."""
    return test(key, (PART, ""))


def referenced_title(title_key: Column, metadata_key: Column) -> Column:
    return not_null((F.length(title_key) >= 6) & metadata_key.contains(title_key))


def title_beside_diwan(title_key: Column, metadata_key: Column) -> Column:
    pair = metadata_key.contains(F.concat(F.lit("ديوان "), title_key)) | metadata_key.contains(F.concat(title_key, F.lit(" ديوان")))
    return not_null((F.size(F.split(title_key, " ")) >= 2) & pair)


def prefixed(column: str, prefix: str) -> Column:
    return not_null(F.col(column).startswith(prefix))
