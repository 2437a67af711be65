"""Curated imports: every input row gets one decision; catalogs and audits are views of the decision table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.normalize import IMPORT, THESIS, normalize
from ..functions.text import (
    FORMAT_WORDS, FORMAT_WORDS_RHETORIC, arabic_title, canonical_archive_title, canonical_list_title, clean_display_title, clean_literature_title, clean_telegram_title, empty_to_null, flatten_json, telegram_post_key,
    textify, title_author_key, truncated_title, url_key, value_list,
)
from ..operators.aggregates import audit, fixed_counts, tag_counts
from ..operators.dedup import against_catalog, greedy
from ..operators.filters import all_arabic_languages, is_pdf_message
from ..operators.joins import first_reason
from ..operators.projections import archive_candidate, better_title, chosen_title, list_candidate
from ..operators.shared import cut
from ..operators.rules import (
    canonical_keys, list_reason, list_tags, literature_reason, literature_tags, primary_category, subject_reason, subject_tags, thesis_level, thesis_signals, with_fallback,
)

# --- fixed values: what an accepted record's evidence says ---
ON_TOPIC, LANGUAGE_SAYS, CONTEXT_SAYS = "مطابقة موضوعية مثبتة لعلوم العربية في بيانات أرشيف", "حقل لغة أرشيف يثبت العربية", "وصف أو موضوع أرشيف يثبت سياق العربية"
DIRECT_LINK, LANGUAGE_IS = "رابط مباشر إلى Internet Archive", "لغة أرشيف: "


@dataclass(frozen=True)
class Import:
    """What an import returns: one row per input (status, reason, related), the rows to add, and the totals."""

    decisions: DataFrame
    accepted: DataFrame
    audit: DataFrame


def _decide(candidates: DataFrame, catalog: DataFrame, keys: dict[str, Column], near_title: str | None, adaptive: bool, ord_: str = "ord") -> DataFrame:
    """Rules first (``reject``), then the existing catalog, then earlier rows of the batch."""
    clean = candidates.filter("reject is null")
    known = catalog
    for k, key in keys.items():
        known = known.withColumn(f"k_{k}", key)
    own = clean
    for k, key in keys.items():
        own = own.withColumn(f"k_{k}", key)
    known, own = cut(known.select("ord", *(f"k_{k}" for k in keys))), cut(own)
    columns = {k: F.col(f"k_{k}") for k in keys}
    met = against_catalog(own, known, columns, near_title and f"k_{near_title}", None, adaptive, ord_)
    met = cut(met)
    fresh = met.filter("existing is null").select(ord_, *(f"k_{k}" for k in keys))
    batch = greedy(fresh, columns, near_title and f"k_{near_title}", adaptive, ord_).select(F.col(ord_).alias("b_ord"), F.col("reason").alias("batch"))
    verdict = met.select(F.col(ord_).alias("v_ord"), "existing").join(batch, F.col("v_ord") == F.col("b_ord"), "left").drop("b_ord")
    out = candidates.join(verdict, F.col(ord_) == F.col("v_ord"), "left").drop("v_ord")
    reason = F.coalesce(F.col("reject"), F.when(F.col("existing").isNotNull(), F.concat(F.lit("existing_"), F.col("existing"))), F.when(F.col("batch").isNotNull(), F.concat(F.lit("batch_"), F.when(F.col("batch") == "near", "near").otherwise("exact"))))
    status = F.when(F.col("reject") == "failed", "failed").when(F.col("reject").isNotNull(), "rejected").when(reason.isNotNull(), "duplicate").otherwise("accepted")
    return out.withColumn("reason", reason).withColumn("status", status).drop("reject", "existing", "batch")


def _result(decisions: DataFrame) -> Import:
    return Import(decisions, decisions.filter("status = 'accepted'"), audit(decisions))


def book_columns(books: DataFrame, metadata: DataFrame, with_archive_title: bool = True) -> DataFrame:
    """Books (identifier, title, archive_item_url, ord) with their archive metadata (identifier, arrays, _fetchError)."""
    m = metadata.select(F.col("identifier").alias("m_id"), F.col("title").alias("m_title"), "creator", "language", "subject", "description", F.col("_fetchError").alias("error"))
    joined = books.join(m, F.col("identifier") == F.col("m_id"), "left").withColumn("missing", F.col("m_id").isNull()).drop("m_id")
    archive_title = F.coalesce(F.try_element_at("m_title", F.lit(1)), F.lit("")) if with_archive_title else F.lit("")
    raw = F.trim(F.coalesce("title", F.lit("")))
    return joined.select(
        "ord", F.trim(F.coalesce("identifier", F.lit(""))).alias("identifier"), F.trim(F.coalesce("archive_item_url", F.lit(""))).alias("url"), raw.alias("raw_title"), archive_title.alias("archive_title"),
        chosen_title(raw, archive_title).alias("title"), F.coalesce("error", F.when(F.col("missing"), "missing")).alias("error"), value_list(F.col("language")).alias("language"), textify(F.col("subject")).alias("subject"),
        textify(F.col("description")).alias("description"), textify(F.col("creator")).alias("creator"),
    )


def archive_import(books: DataFrame, metadata: DataFrame, catalog: DataFrame, pack: str = "literature") -> Import:
    """Books of an archive through a rule pack: literature, grammar or rhetoric."""
    b = cut(book_columns(books, metadata, pack != "rhetoric"))
    c = {k: F.col(k) for k in ("title", "raw_title", "archive_title", "identifier", "url", "error", "language", "subject", "description", "creator", "tags")}
    titles = F.concat_ws(" ", "title", "raw_title", "archive_title")
    if pack == "literature":
        tags = with_fallback(literature_tags(F.concat_ws(" ", titles, "subject")), literature_tags(F.col("subject")))
        b = b.withColumn("tags", tags).withColumn("reject", literature_reason(c))
    else:
        rules, topic, forgiven = {"grammar": (packs.GRAMMAR, "nahw_irab", None), "rhetoric": (packs.RHETORIC, None, "rhetoric")}[pack]
        tags = with_fallback(subject_tags(F.concat_ws(" ", titles, "description"), rules), subject_tags(F.col("subject"), rules))
        b = b.withColumn("tags", tags).withColumn("reject", subject_reason(c, rules, topic, forgiven))
    b = cut(b)
    shown = F.coalesce(empty_to_null(clean_literature_title(F.col("title"))), F.col("title"))
    b = b.withColumn("match_title", F.col("title")).withColumn("title", shown).withColumn("author", empty_to_null(F.col("creator"))).withColumn("sourceUrl", F.col("url")).withColumn("primaryCategory", primary_category(F.col("tags"), pack == "literature"))
    arabic = all_arabic_languages(F.col("language"))
    strong = F.array(F.lit(ON_TOPIC), F.when(arabic, LANGUAGE_SAYS).otherwise(CONTEXT_SAYS))
    supporting = F.concat(F.array(F.lit(DIRECT_LINK)), F.transform("language", lambda v: F.concat(F.lit(LANGUAGE_IS), v)))
    b = archive_candidate(b, strong, supporting, arabic)
    words = FORMAT_WORDS_RHETORIC if pack == "rhetoric" else FORMAT_WORDS
    known = catalog.withColumn("match_title", F.col("title"))
    title = canonical_archive_title(F.col("match_title"), words)
    keys = {"id": F.trim("id"), "url": url_key(F.col("sourceUrl")), "title": title, "title_author": title_author_key(title, normalize(F.coalesce("author", F.lit("")), IMPORT))}
    return _result(_decide(b, known, keys, "title", False))


def title_list_import(titles: DataFrame, catalog: DataFrame, signal: str = "عنوان من قائمة مصنّفة", folder: str = "عناوين/") -> Import:
    """Titles of a list (sourceCategory, title, ord): relevance, tags, then adaptive near titles."""
    manual = dict(zip(canonical_keys(list(packs.MANUAL_TITLE_TAGS)), packs.MANUAL_TITLE_TAGS.values(), strict=True))
    relevant = canonical_keys(packs.RELEVANT_TITLES)
    t = titles.withColumn("title", clean_display_title(F.col("title"))).withColumn("title_key", canonical_list_title(F.col("title")))
    t = cut(t).withColumn("tags", list_tags(F.col("title"), F.col("title_key"), F.col("sourceCategory"), manual, relevant))
    t = t.withColumn("reject", list_reason(F.col("title"), F.col("title_key"), F.col("sourceCategory"), F.col("tags"), [*manual, *relevant])).withColumn("primaryCategory", primary_category(F.col("tags"), False))
    t = list_candidate(cut(t), "title_key", signal, folder)
    keys = {"id": F.trim("id"), "url": F.regexp_replace(F.coalesce("sourceUrl", F.lit("")), "/+$", ""), "title": canonical_list_title(F.col("title"))}
    return _result(_decide(t, catalog, keys, "title", True))


def thesis_candidates(messages: DataFrame, channel: str) -> DataFrame:
    """PDF messages with a title worth keeping: the better of file name and text, its score, tags and level."""
    m = messages.filter(is_pdf_message(F.col("type"), F.col("mime_type"), F.col("file_name"))).withColumn("text", flatten_json(F.col("text")))
    m = m.withColumn("title", better_title(clean_telegram_title(F.col("file_name")), clean_telegram_title(F.col("text")), lambda t: thesis_signals(t)[0])).filter("title is not null")
    m = cut(m)
    score, tags, names = thesis_signals(F.col("title"))
    m = m.withColumn("score", score).withColumn("tags", tags).withColumn("signals", names).withColumn("level", thesis_level(F.concat_ws(" ", "title", "text"))).withColumn("truncated", truncated_title(F.col("title")))
    keep = (F.col("score") >= 4) & F.col("title").rlike(r"[\x{0621}-\x{064A}]")
    return m.withColumn("accepted", keep).withColumn("confident", F.col("score") >= 6).withColumn("title_key", normalize(F.col("title"), THESIS)).withColumn("messageId", F.col("id")).withColumn("channel", F.lit(channel))


def thesis_import(theses: DataFrame, catalog: DataFrame) -> Import:
    """Theses (id, title, author, sourceUrl, tags, ord) by equal keys only; the first key in order gives the reason."""
    title, author = normalize(F.coalesce("title", F.lit("")), IMPORT), normalize(F.coalesce("author", F.lit("")), IMPORT)
    keys = {"id": F.trim("id"), "url": url_key(F.col("sourceUrl")), "post": telegram_post_key(F.col("sourceUrl")), "title_author": title_author_key(title, author), "title": title}
    known = first_reason(theses, catalog, keys, "existing")
    fresh = known.filter("existing is null")
    batch = greedy(fresh, keys).select(F.col("ord").alias("b_ord"), F.col("reason").alias("batch"))
    out = known.join(batch, F.col("ord") == F.col("b_ord"), "left").drop("b_ord")
    reason = F.coalesce(F.concat(F.lit("existing_"), F.col("existing")), F.concat(F.lit("batch_"), F.col("batch")))
    return _result(out.withColumn("reason", reason).withColumn("status", F.when(reason.isNotNull(), "duplicate").otherwise("accepted")).drop("existing", "batch"))


def accepted_by_tag(result: Import, tags: list[str] | None = None) -> DataFrame:
    """Accepted rows per tag; a fixed list shows its zeros too."""
    if tags is None:
        return tag_counts(result.accepted)
    return fixed_counts(result.accepted.select(F.explode("tags").alias("tag")), "tag", tags)


def arabic_only(df: DataFrame) -> DataFrame:
    return df.filter(arabic_title(F.col("title")))
