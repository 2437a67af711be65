"""Writers: JSON documents, dry runs, metadata patches, caches, capped logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import last_wins
from ..operators.ordering import running_sum

# --- fixed values: size of a log and the share kept when it is trimmed ---
LOG_CAP, LOG_KEEP = 1024 * 1024, 0.6


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def commit(catalog: DataFrame, audit: DataFrame, catalog_path: str, audit_path: str, apply: bool = False) -> None:
    """The audit is always written, the catalog only with ``apply``."""
    write_json(audit, audit_path)
    if apply:
        catalog.write.mode("overwrite").parquet(catalog_path)


def patch_metadata(metadata: DataFrame, note: str, total: Column | int, field: str = "metadata") -> DataFrame:
    """The metadata map with a note appended once and the record total brought up to date."""
    m = F.col(field)
    notes = F.coalesce(F.try_element_at(m, F.lit("notes")), F.lit(""))
    new = F.when(notes.contains(note), notes).when(notes == "", F.lit(note)).otherwise(F.concat(notes, F.lit(" "), F.lit(note)))
    patch = F.create_map(F.lit("notes"), new, F.lit("totalMaterials"), (total if isinstance(total, Column) else F.lit(total)).cast("string"))
    return metadata.withColumn(field, F.map_concat(F.map_filter(m, lambda k, _: ~k.isin("notes", "totalMaterials")), patch))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new one of equal keys."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return last_wins(both.withColumn("_ord", F.col("_seq")), key, "_seq", "_ord").drop("_ord")


def upsert_in_order(old: DataFrame, new: DataFrame, key: str, ord_: str = "ord") -> DataFrame:
    """The same for ordered catalogs: the new record at the old one's place, others after all old ones."""
    places = old.agg(F.coalesce(F.max(ord_), F.lit(-1)).alias("_last"))
    shifted = new.crossJoin(F.broadcast(places)).withColumn("_seq", F.col(ord_) + F.col("_last") + 1).drop("_last")
    return last_wins(old.withColumn("_seq", F.col(ord_)).unionByName(shifted), key, "_seq", ord_)


def log_line(entry: Column, at: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] "), entry)


def trim_log(lines: DataFrame, text: str, ord_: str, group: Sequence[str], cap: int = LOG_CAP, keep: float = LOG_KEEP) -> DataFrame:
    """Logs over ``cap`` bytes keep their newest lines of at most ``keep`` of it; others stay whole."""
    size = lines.groupBy(*group).agg(F.sum(F.octet_length(F.col(text)) + 1).alias("_size"))
    run = running_sum(lines, F.octet_length(F.col(text)) + 1, list(group), F.col(ord_).desc(), name="_running")
    out = run.join(F.broadcast(size), list(group))  # one row for each log
    return out.filter((F.col("_size") <= cap) | (F.col("_running") <= int(cap * keep))).select(*lines.columns)
