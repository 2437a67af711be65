"""Counts, facets, keep-best and merge aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_person, trim
from ..schema import ARCHIVE_SOURCE, UNSPECIFIED

EMPTY_LABEL = "(فارغ)"


def filtered_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row (name, n) per condition, from one pass; conditions may overlap."""
    one = df.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in conditions))
    return one.select(F.explode(pairs).alias("p")).select("p.name", "p.n")


def unspecified(column: Column, label: str = UNSPECIFIED) -> Column:
    return F.coalesce(F.nullif(trim(column), F.lit("")), F.lit(label))


def facet_counts(df: DataFrame, chosen: Mapping[str, str]) -> DataFrame:
    """(dimension, value, n): counts of each dimension's values under all other choices.

    One pass: every row offers each of its dimensions whose other choices it
    meets. A chosen value without rows is there with 0.
    """
    dims = list(chosen)
    met = {d: F.lit(True) if chosen[d] == "all" else F.coalesce(F.col(d) == chosen[d], F.lit(False)) for d in dims}
    offers = []
    for d in dims:
        others = F.lit(True)
        for e in dims:
            if e != d:
                others = others & met[e]
        offers.append(F.when(others, F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))))
    counts = df.select(F.explode(F.array_compact(F.array(*offers))).alias("o")).groupBy("o.dimension", "o.value").agg(F.count("*").alias("n"))
    picked = [(d, v) for d, v in chosen.items() if v != "all"]
    if not picked:
        return counts
    zero = df.sparkSession.createDataFrame([(d, v, 0) for d, v in picked], "dimension string, value string, n long")
    return counts.unionByName(zero).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def last_wins(df: DataFrame, key: str, seq: str, ord_: str = "ord") -> DataFrame:
    """The last row of each key, at the place of the key's first."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r"), F.min(seq).alias("_first")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest if c != ord_), F.col("_first").alias(ord_))


def keep_best(df: DataFrame, keys: Sequence[str], score: str, ord_: str = "ord") -> DataFrame:
    """The best-scored row of each key; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ord_).asc())
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def source_priority(source: Column) -> Column:
    return F.when(source == ARCHIVE_SOURCE, 0).otherwise(1)


@dataclass(frozen=True)
class Merged:
    """Records of identities, and what was merged into them in tables of their own, so that no identity is gathered."""

    records: DataFrame
    references: DataFrame
    members: DataFrame


def merge_tables(df: DataFrame, key: str = "identity") -> Merged:
    """One record of each identity: the preferred source's, with the number of its references and rows.

    References are distinct by address, the first of each; they come from an
    aggregate by (identity, address) and are counted in a second one. The
    author is the preferred record's unless that is generic; then the first
    record's, as folding the records in order would leave it.
    """
    first = F.min_by(F.struct("id", "title", "author", "source", "sourceUrl"), F.col("ord"))
    best = F.min_by(F.struct("id", "title", "author", "source", "sourceUrl", "volumes", "pages"), F.struct(source_priority(F.col("source")), F.col("ord")))
    heads = df.groupBy(key).agg(first.alias("f"), best.alias("b"), F.count("*").alias("mergedCount"), F.min("ord").alias("ord"))
    references = df.groupBy(key, F.col("sourceUrl").alias("url")).agg(F.min_by("source", "ord").alias("source"), F.min("ord").alias("ord"))
    counts = references.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("sourceCount"))
    author = F.when(canonical_person(F.col("b.author")) != "", F.col("b.author")).otherwise(F.col("f.author"))
    records = heads.join(counts, F.col(key).eqNullSafe(F.col("_key"))).select(key, "b.id", "b.title", author.alias("author"), "b.source", "b.sourceUrl", "b.volumes", "b.pages", "sourceCount", "mergedCount", "ord")
    return Merged(records, references, df.select(key, "id", "ord"))


def merge_identity(df: DataFrame, key: str = "identity") -> DataFrame:
    """The records of ``merge_tables`` with their references and merged ids as arrays, for a catalog's JSON; a record is as large as its identity."""
    m = merge_tables(df, key)
    refs = m.references.groupBy(F.col(key).alias("_r")).agg(F.array_sort(F.collect_list(F.struct("ord", "source", "url"))).alias("refs"))
    ids = m.members.groupBy(F.col(key).alias("_m")).agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("ids"))
    out = m.records.join(refs, F.col(key).eqNullSafe(F.col("_r"))).join(ids, F.col(key).eqNullSafe(F.col("_m")))
    plain = F.transform("refs", lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url")))
    kept = [key, "id", "title", "author", "source", "sourceUrl", "volumes", "pages"]
    return out.select(*kept, plain.alias("sourceRefs"), F.col("sourceCount").cast("int").alias("sourceCount"), F.transform("ids", lambda x: x["id"]).alias("mergedIds"), "ord")


def count_by(df: DataFrame, key: str, ord_: str | None = None) -> DataFrame:
    """(key, n), with the place of its first row if asked for; order by n desc, first asc."""
    aggs = [F.count("*").alias("n")] + ([F.min(ord_).alias("first")] if ord_ else [])
    return df.groupBy(key).agg(*aggs)


def histogram(df: DataFrame, key: Column, label: str = EMPTY_LABEL) -> DataFrame:
    return df.groupBy(unspecified(key, label).alias("value")).agg(F.count("*").alias("n"))


def _tags(df: DataFrame, tags: str) -> DataFrame:
    """One row (tag) per tag. The outer form, since the other one is given filters that compute the whole list twice more."""
    return df.select(F.posexplode_outer(tags).alias("_at", "tag")).filter("_at is not null").select("tag")


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    return _tags(df, tags).groupBy("tag").agg(F.count("*").alias("n"))


def tag_set(df: DataFrame, tags: str = "tags") -> DataFrame:
    return _tags(df, tags).distinct()


def fixed_counts(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(value, n) for a fixed list of values, zeros included."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    found = df.groupBy(F.col(key).alias("_v")).agg(F.count("*").alias("_n"))
    return wanted.join(found, F.col("value") == F.col("_v"), "left").select("value", F.coalesce("_n", F.lit(0)).alias("n"))


def duplicate_groups(df: DataFrame, key: str, record: Sequence[str], most: int | None = 50) -> DataFrame:
    """(key, n, records) of keys with more than one row; ``records`` shows the first ``most`` of them, all if None.

    Counts cover all rows; the shown list is bounded so that a hot key never
    gathers in one task, unless all are asked for.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    first = df
    if most is not None:
        first = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("_rank") <= most)
    shown = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", *record))).alias("records"))
    return counts.join(shown, key)


def duplicate_values(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count(key) - F.count_distinct(key)).alias("duplicates"))


def every(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(True))


def some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def score_sum(rules: Sequence[tuple[Column, int]]) -> Column:
    out = F.lit(0)
    for condition, score in rules:
        out = out + F.when(condition, score).otherwise(0)
    return out


def audit(decisions: DataFrame, status: str = "status", reason: str = "reason") -> DataFrame:
    """Totals of a decision table, and whether they add up."""
    by = lambda v: F.count_if(F.col(status) == v)
    return decisions.agg(F.count("*").alias("input"), by("accepted").alias("accepted"), by("rejected").alias("rejected"), by("duplicate").alias("duplicates"), by("failed").alias("failed")).withColumn(
        "balanced", F.col("accepted") + F.col("rejected") + F.col("duplicates") + F.col("failed") == F.col("input")
    )
