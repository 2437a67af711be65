"""Assembly of the catalog from its batches, in their order of priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import CATALOG_TITLE, SEARCH, normalize
from ..operators.joins import prioritized_union
from ..operators.projections import haystack


def by(*names: str) -> dict[str, Column]:
    """Key columns by name: id, url, and the normalised title that the union compares."""
    all_keys = {"id": F.col("id"), "url": F.col("sourceUrl"), "title": normalize(F.col("title"), CATALOG_TITLE)}
    return {n: all_keys[n] for n in names}


@dataclass(frozen=True)
class Batch:
    """A batch's name and the keys on which it yields to earlier ones; the base yields to none."""

    name: str
    keys: tuple[str, ...] = ()


# --- fixed values: the batches in order of priority ---
ORDER = (
    Batch("base"), Batch("rhetorical", ("id", "url")), Batch("qiraat", ("id", "url", "title")), Batch("gap", ("id", "url", "title")), Batch("literary_clubs", ("id", "url")), Batch("osool", ("id", "url")),
    Batch("user_curated", ("id", "url")), Batch("heritage", ("id", "url", "title")), Batch("million_books", ("id", "url", "title")), Batch("archive_01", ("id", "url", "title")), Batch("archive_02", ("id", "url", "title")),
    Batch("archive_03", ("id", "url", "title")), Batch("archive_04", ("id", "url", "title")), Batch("archive_05_09", ("id", "url", "title")),
)
DISPLAY_STATS_UPTO = "osool"


def ranked(df: DataFrame, rank: int) -> DataFrame:
    return df.withColumn("batch_rank", F.lit(rank))


def assemble(batches: Mapping[str, DataFrame], order: Sequence[Batch] = ORDER, upto: str | None = None) -> DataFrame:
    """The prioritised union of the batches that are there; ``ord`` within a batch and its rank make the catalog's order."""
    frames, keys = [], []
    for rank, b in enumerate(order):
        if b.name in batches:
            frames.append(ranked(batches[b.name], rank))
            keys.append(by(*b.keys))
        if b.name == upto:
            break
    return prioritized_union(frames, keys)


def silver(catalog: DataFrame) -> DataFrame:
    """The catalog with its search keys, computed once so that searches filter plain columns."""
    return catalog.withColumn("search_key", haystack()).withColumn("title_key", normalize(F.col("title"), SEARCH))
