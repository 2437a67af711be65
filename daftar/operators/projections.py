"""Adapters from the sources' records to the catalog's, and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import SEARCH, normalize
from ..functions.text import arabic_title, catalog_identifier, empty_to_null, encode_component, safe_path, search_url, shorten, shown_title, stable_id, trim
from ..schema import ARCHIVE_SOURCE, CURRICULUM_NAMES, UNSPECIFIED
from .aggregates import unspecified
from .filters import is_scientific_poem

# --- fixed values: signals, tags, labels and path templates of the adapters ---
SIGNALS = {"diwans": "سجل ديوان موثّق", "curricula": "سجل منهج ومقرر منقّى", "academies": "سجل مجمع لغوي موثّق", "literary_clubs": "سجل نادي أدبي موثّق"}
KIND_TAGS = {"curricula": "المناهج والمقررات", "academies": "المجامع اللغوية", "literary_clubs": "الأندية الأدبية"}
CATEGORY_LABELS = {
    "all": "جميع المواد", "academic_theses": "الرسائل العلمية", "references": "المصادر والمراجع", "dictionaries": "المعاجم اللغوية", "bilingual_dictionaries": "القواميس الثنائية",
    "diwans": "الدواوين", "scientific_poems": "المنظومات العلمية", "curricula": "المناهج والمقررات", "academies": "المجامع اللغوية", "literary_clubs": "الأندية الأدبية",
}
YEAR = "سنة "
EXCLUDED_DIWANS = ("archive-20260411_20260411_1046",)
SEARCH_SOURCE = "مركز المعرفة الرقمي (بحث)"


def tag_list(*values: Column) -> Column:
    """Distinct non-empty values in order."""
    return F.array_distinct(F.filter(F.array(*values), lambda v: v.isNotNull() & (v != "")))


def evidence(strong: Column, supporting: Column, explicit: Column | None = None) -> Column:
    return F.struct(strong.alias("strongSignals"), supporting.alias("supportingSignals"), (F.lit(True) if explicit is None else explicit).alias("explicitLanguageSource"))


def diwans(df: DataFrame, excluded=EXCLUDED_DIWANS, signal: str = SIGNALS["diwans"]) -> DataFrame:
    signals = F.array_distinct(F.array_append(F.coalesce("matchEvidence.strongSignals", F.array().cast("array<string>")), F.lit(signal)))
    return df.filter(~F.col("id").isin(*excluded)).withColumn("relativePath", F.col("sourceUrl")).withColumn("matchEvidence", F.col("matchEvidence").withField("strongSignals", signals))


def curricula(df: DataFrame, collection: str, signal: str = SIGNALS["curricula"]) -> DataFrame:
    c = df.withColumnsRenamed(CURRICULUM_NAMES)
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    parts = F.concat(F.array(F.lit(KIND_TAGS["curricula"]), F.col("type"), F.col("stage"), F.col("audience"), F.col("country"), F.col("verification")), labels)
    tags = F.filter(parts, lambda v: v.isNotNull() & (v != ""))
    url = trim(F.coalesce("url", F.lit("")))
    organization = empty_to_null(trim(F.col("organization")))
    return c.select(
        F.concat(F.lit("curricula-"), F.col("number").cast("string")).alias("id"), trim(F.col("title")).alias("title"), organization.alias("author"),
        F.coalesce(organization, empty_to_null(trim(F.col("country"))), F.lit(collection)).alias("source"), url.alias("relativePath"), url.alias("sourceUrl"), F.lit("curricula").alias("primaryCategory"),
        F.array_distinct(tags).alias("tags"), evidence(F.array(F.lit(signal), F.col("type")), tags).alias("matchEvidence"),
    )


def _institution(df: DataFrame, kind: str, prefix: str, source: str, url: Column, *extra: str) -> DataFrame:
    year = F.when(F.col("year") == UNSPECIFIED, F.col("year")).otherwise(F.concat(F.lit(YEAR), F.col("year")))
    parts = F.array(F.lit(KIND_TAGS[kind]), F.col("materialType"), F.col("country"), *(F.col(c) for c in extra), year, F.col("linkStatus"))
    tags = F.filter(parts, lambda v: v.isNotNull() & (v != ""))
    return df.select(
        F.concat(F.lit(prefix), F.col("id")).alias("id"), "title", F.when(F.col("country") != UNSPECIFIED, F.col("country")).alias("author"), F.col(source).alias("source"), F.col("sourceFile").alias("relativePath"),
        url.alias("sourceUrl"), F.lit(kind).alias("primaryCategory"), F.array_distinct(tags).alias("tags"), evidence(F.array(F.lit(SIGNALS[kind]), F.col("materialType")), tags).alias("matchEvidence"),
    )


def academies(df: DataFrame) -> DataFrame:
    return _institution(df, "academies", "academies-", "academy", F.col("url"))


def literary_clubs(df: DataFrame) -> DataFrame:
    return _institution(df, "literary_clubs", "literary-clubs-", "club", F.coalesce("url", F.lit("")), "city")


def facet_struct(*columns: str) -> Column:
    return F.struct(*(unspecified(F.col(c)).alias(c) for c in columns))


def haystack(profile=SEARCH) -> Column:
    """Normalised title, author, source and tags."""
    return normalize(F.concat_ws(" ", empty_to_null(F.col("title")), empty_to_null(F.col("author")), empty_to_null(F.col("source")), empty_to_null(F.array_join("tags", " "))), profile)


def category_label() -> Column:
    pairs = [F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv]
    return F.when(is_scientific_poem(), F.lit(CATEGORY_LABELS["scientific_poems"])).otherwise(F.try_element_at(F.create_map(*pairs), F.col("primaryCategory")))


def link_action() -> Column:
    """What a record's link does: copy, open a post, the archive, a search, a page, or nothing."""
    url = F.coalesce(F.col("sourceUrl"), F.lit(""))
    return (
        F.when(url == "", "none").when(url.rlike(r"(?i)^https?://(?:www\.)?buhooth\.link(?::\d+)?/"), "copy").when(F.col("source") == SEARCH_SOURCE, "search")
        .when(url.rlike(r"(?i)^https?://t\.me/"), "telegram").when(url.rlike(r"(?i)^https?://(?:www\.)?archive\.org/"), "archive").otherwise("open")
    )


def card(df: DataFrame) -> DataFrame:
    """What a result card shows."""
    return df.withColumn("catalogIdentifier", catalog_identifier(F.col("title"))).withColumn("displayTitle", shown_title(F.col("title"))).withColumn("categoryLabel", category_label()).withColumn("action", link_action())


def archive_candidate(df: DataFrame, strong: Column, supporting: Column, explicit: Column, folder: str = "أرشيف/مواد عربية/") -> DataFrame:
    """Archive books as records: identifier, title, author, sourceUrl, primaryCategory and tags are there already."""
    path = F.concat(F.lit(folder), F.col("identifier"), F.lit("/"), safe_path(F.col("title")), F.lit(".pdf"))
    return df.withColumn("id", F.concat(F.lit("archive-"), F.col("identifier"))).withColumn("source", F.lit(ARCHIVE_SOURCE)).withColumn("relativePath", path).withColumn("matchEvidence", evidence(strong, supporting, explicit))


def list_candidate(df: DataFrame, key: str, signal: str, folder: str) -> DataFrame:
    """Titles of a list as records with a hashed id and a search address."""
    strong, supporting = F.array(F.lit(signal)), F.array(F.concat(F.lit("تصنيف الملف الأولي: "), F.col("sourceCategory")))
    return (
        df.withColumn("id", stable_id(F.col(key))).withColumn("author", F.lit(None).cast("string")).withColumn("source", F.lit(SEARCH_SOURCE)).withColumn("relativePath", F.concat(F.lit(folder), safe_path(F.col("title"))))
        .withColumn("sourceUrl", search_url(F.col("title"))).withColumn("matchEvidence", evidence(strong, supporting))
    )


def thesis_record(df: DataFrame, channel: str) -> DataFrame:
    """Theses with their level first among the tags."""
    return df.withColumn("tags", F.array_distinct(F.concat(F.array("level"), "tags"))).withColumn("relativePath", F.concat(F.lit("تيليجرام/رسائل/"), F.col("messageId").cast("string"))).withColumn("sourceUrl", F.concat(F.lit(f"https://t.me/{channel}/"), F.col("messageId").cast("string")))


def diwan_record(df: DataFrame) -> DataFrame:
    return df.withColumn("volumes", F.coalesce("volumes", F.lit(None).cast("int"))).withColumn("pages", F.coalesce("pages", F.lit(None).cast("int"))).withColumn("archiveUrl", F.concat(F.lit("https://archive.org/details/"), encode_component(F.col("identifier"))))


def audit_row(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "url", "reason", "language", shorten(F.col("subject"), 300).alias("subject"))


def chosen_title(raw: Column, archive: Column) -> Column:
    """The archive's title if it is Arabic, else the given one."""
    named = trim(F.coalesce(archive, F.lit("")))
    return F.when((named != "") & arabic_title(named), named).otherwise(trim(F.coalesce(raw, F.lit(""))))


def better_title(first: Column, second: Column, score) -> Column:
    """Of two titles the one of higher score, then the longer, then the first; null if both are empty."""
    option = lambda t, k: F.when(t != "", F.struct(score(t).alias("s"), F.length(t).alias("n"), F.lit(-k).alias("k"), t.alias("t")))
    return F.greatest(option(first, 0), option(second, 1))["t"]


def shown_count(n: Column) -> Column:
    return F.format_number(n, 0)


EXPORT_NAMES = {"sourceUrl": "url"}


def exported(df: DataFrame, names=EXPORT_NAMES) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
