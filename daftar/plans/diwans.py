"""The diwan chain: classify a harvest, refine it, merge batches, merge sources into one catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import REFINE, UPLOAD, normalize
from ..functions.text import CATALOG_TITLE, REFINE_TITLE, canonical_diwan_title, canonical_person, clean_catalog_title, clean_person, clean_title, identity, identity_material
from ..operators.aggregates import keep_best, last_wins, merge_identity
from ..operators.shared import cut
from ..operators.filters import is_texts
from ..operators.joins import anti_keys, retract
from ..operators.rules import confidence, diwan_evidence, diwan_reason, diwan_score, merge_reason, poet, refine_reason, upload_reason

NO_AUTHOR = "لم يُثبت اسم الشاعر في المصدر"


def classify(docs: DataFrame, faithful_v4: bool = False) -> DataFrame:
    """Archive documents (arrays, ord) with title, evidence, poet, reason and score."""
    join = lambda c, by: F.array_join(F.coalesce(c, F.array().cast("array<string>")), by)
    d = docs.filter(is_texts(F.col("mediatype"))).withColumn("raw_title", join("title", " ")).withColumn("creator_name", F.coalesce(F.try_element_at("creator", F.lit(1)), F.lit("")))
    d = d.withColumn("title", clean_title(F.col("raw_title"))).withColumn("subject", join("subject", " · ")).withColumn("description", join("description", " "))
    d = cut(d)
    d = d.withColumn("evidence", diwan_evidence(F.col("title"), F.col("subject"), F.col("description"), F.col("creator_name"))).withColumn("poet", poet(F.col("raw_title"), F.col("creator_name")))
    d = d.withColumn("reason", diwan_reason(F.col("title"), F.col("subject"), F.col("description"), F.col("evidence"))).withColumn("canonical", canonical_diwan_title(F.col("raw_title")))
    return d.withColumn("author", clean_person(F.col("creator_name"))).withColumn("score", diwan_score(F.col("evidence"), F.col("poet"), F.col("subject"), F.col("description"), F.col("language"), faithful_v4))


def harvest(docs: DataFrame, seq: str = "ord") -> DataFrame:
    """Eligible documents: the last of each identifier, then the best of each canonical title."""
    rows = classify(last_wins(docs, "identifier", seq, "ord"))
    return keep_best(rows.filter("reason is null"), ["canonical"], "score")


def refine(materials: DataFrame) -> DataFrame:
    """Materials with clean titles, without noise, the most certain of each title and author; rejected ones have a reason."""
    m = materials.withColumn("title", clean_title(F.col("title"), REFINE_TITLE))
    m = cut(m)
    m = m.withColumn("reason", refine_reason(F.col("title"))).withColumn("confidence", confidence(F.col("title"), F.col("author"), F.try_element_at("matchEvidence.strongSignals", F.lit(2)), F.col("sourceUrl")))
    author = F.regexp_replace(normalize(F.coalesce("author", F.lit("")), REFINE), "^لم يثبت اسم الشاعر في السجل$", "")
    keyed = m.withColumn("_title", normalize(F.col("title"), REFINE)).withColumn("_author", author)
    kept = keep_best(keyed.filter("reason is null"), ["_title", "_author"], "confidence")
    return kept.unionByName(keyed.filter("reason is not null")).drop("_title", "_author")


def merge_batches(previous: DataFrame, expanded: DataFrame) -> DataFrame:
    """Both batches by id; the expanded one's record wins, at the earlier place."""
    last = previous.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    later = expanded.crossJoin(F.broadcast(last)).withColumn("_seq", F.col("ord") + F.col("_last") + 1).drop("_last")
    return last_wins(previous.withColumn("_seq", F.col("ord")).unionByName(later), "id", "_seq", "ord")


def upload(candidates: DataFrame, archive: DataFrame, added_before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new archive, decisions) of an upload: best per identifier, eligible, best per title, new to the archive; what is no longer eligible is retracted."""
    c = classify_upload(candidates)
    best = keep_best(c, ["identifier"], "score")
    eligible = keep_best(best.filter("reason is null"), ["canonical"], "score")
    current = retract(archive, added_before, best.filter("reason is null").withColumn("id", F.concat(F.lit("archive-"), F.col("identifier"))))
    key = lambda t, a: identity_material(canonical_diwan_title(t, UPLOAD), canonical_person(a))
    keys = {"id": F.col("id"), "identity": key(F.col("title"), F.col("author")), "title": canonical_diwan_title(F.col("title"), UPLOAD)}
    fresh = anti_keys(eligible.withColumn("id", F.concat(F.lit("archive-"), F.col("identifier"))), current, keys)
    return current.unionByName(fresh.select(*[c for c in current.columns if c in fresh.columns]), allowMissingColumns=True), best


def classify_upload(docs: DataFrame) -> DataFrame:
    join = lambda c, by: F.array_join(F.coalesce(c, F.array().cast("array<string>")), by)
    d = docs.withColumn("raw_title", join("title", " ")).withColumn("creator_name", F.coalesce(F.try_element_at("creator", F.lit(1)), F.lit("")))
    d = d.withColumn("title", clean_title(F.col("raw_title"))).withColumn("subject", join("subject", " · ")).withColumn("description", join("description", " "))
    d = cut(d)
    d = d.withColumn("evidence", diwan_evidence(F.col("title"), F.col("subject"), F.col("description"), F.col("creator_name"))).withColumn("poet", poet(F.col("raw_title"), F.col("creator_name"), before=False))
    d = d.withColumn("reason", upload_reason(F.col("identifier"), F.col("title"), F.col("subject"), F.col("description"), F.col("language"), F.col("evidence")))
    return d.withColumn("canonical", canonical_diwan_title(F.col("raw_title"), UPLOAD)).withColumn("author", clean_person(F.col("creator_name"))).withColumn("score", diwan_score(F.col("evidence"), F.col("poet"), F.col("subject"), F.col("description"), F.col("language")))


def catalog(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected) of source records (id, title, author, source, sourceUrl, signals, volumes, pages, ord)."""
    r = records.withColumn("title", clean_catalog_title(F.col("title"))).withColumn("author", F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit(NO_AUTHOR)))
    r = cut(r)
    r = r.withColumn("reason", merge_reason(F.col("title"), F.col("author"), F.array_join(F.coalesce("signals", F.array().cast("array<string>")), " ")))
    r = r.withColumn("identity", identity(canonical_diwan_title(F.col("title"), UPLOAD, CATALOG_TITLE), canonical_person(F.col("author"))))
    return merge_identity(r.filter("reason is null")), r.filter("reason is not null")
