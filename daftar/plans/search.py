"""Answers to search, category, facet, statistics and paging requests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import facet_counts, filtered_counts
from ..operators.filters import ALL, PRIORITY_COUNTRY, category, default_view, facets, is_scientific_poem, is_standalone_diwan, stat, tokens_and
from ..operators.ordering import Page, collated, page
from ..schema import CATEGORIES

STATS = (ALL, "linguistics", "lexicon-literature-rhetoric", "diwans")
FACETS = {
    "curricula": ("country", "materialType", "organization"),
    "academies": ("academy", "country", "materialType", "year", "linkStatus"),
    "literary_clubs": ("club", "country", "city", "materialType", "year", "linkStatus"),
}


@dataclass(frozen=True)
class Request:
    query: str = ""
    category: str = ALL
    stat: str = ALL
    facets: Mapping[str, str] = field(default_factory=dict)
    page: int = 1
    bilingual_ids: tuple[str, ...] = ()

    @property
    def active(self) -> bool:
        return bool(self.query.strip()) or self.category != ALL or self.stat != ALL


def results(catalog: DataFrame, r: Request) -> DataFrame:
    """Rows of a request; without any choice, the default view.

    ``catalog`` has search_key and title_key. All conditions are one conjunction
    of plain column tests, which reaches the scan.
    """
    if not r.active:
        return catalog.filter(default_view(F.col("title_key")))
    return catalog.filter(category(r.category, r.bilingual_ids) & facets(r.facets) & tokens_and(F.col("search_key"), r.query) & stat(r.stat))


def by_facet_table(catalog: DataFrame, entries: DataFrame, kind: str, chosen: Mapping[str, str], key: str = "id") -> DataFrame:
    """Rows of a category whose entry in a table of facets meets the choices; rows without an entry are left out."""
    known = {c: v for c, v in chosen.items() if v != ALL}
    return catalog.filter(F.col("primaryCategory") == kind).join(entries.filter(facets(known)).select(key), key, "left_semi")


class Views:
    """Results of the latest requests over one catalog, at most ``most`` of them; the least recently asked one is released."""

    def __init__(self, catalog: DataFrame, most: int = 16):
        self.catalog, self.most, self.kept = catalog, most, {}

    def results(self, r: Request) -> DataFrame:
        key = (r.query.strip(), r.category, r.stat, tuple(sorted(r.facets.items())), r.bilingual_ids)
        df = self.kept.pop(key, None)
        if df is None:
            df = results(self.catalog, r).persist()
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept))).unpersist()
        self.kept[key] = df  # the latest is the last
        return df

    def replace(self, catalog: DataFrame) -> None:
        """A new catalog: what was kept is released."""
        for df in self.kept.values():
            df.unpersist()
        self.catalog, self.kept = catalog, {}


def ordered_page(catalog: DataFrame, r: Request) -> Page:
    """A page of a request: clubs of the priority country first, otherwise the catalog's order."""
    rows = results(catalog, r)
    if r.category == "literary_clubs" and "country" in rows.columns:
        rows = rows.withColumn("_first", F.when(F.col("country") == PRIORITY_COUNTRY, 0).otherwise(1))
        return page(rows, r.page, "_first", "batch_rank", "ord")
    return page(rows, r.page, "batch_rank", "ord")


def facet_options(catalog: DataFrame, kind: str, chosen: Mapping[str, str]) -> DataFrame:
    """Facet values of a category with their counts, independent of query and page."""
    full = {d: chosen.get(d, ALL) for d in FACETS[kind]}
    return facet_counts(catalog.filter(F.col("primaryCategory") == kind), full)


def option_order(options: DataFrame, priority: str = PRIORITY_COUNTRY) -> DataFrame:
    first = F.when(F.col("dimension").isin("country", "club") & (F.col("value") == priority), 0).otherwise(1)
    return options.orderBy("dimension", first, collated(F.col("value")), "value")


def category_counts(catalog: DataFrame, bilingual_ids: Iterable[str] = ()) -> DataFrame:
    """Counts of the ten category buttons; they overlap."""
    return filtered_counts(catalog, {c: category(c, tuple(bilingual_ids)) for c in (ALL, *CATEGORIES)})


def stat_cards(catalog: DataFrame) -> DataFrame:
    return filtered_counts(catalog, {s: stat(s) for s in STATS})


def global_counts(catalog: DataFrame) -> DataFrame:
    kinds = {"diwans": is_standalone_diwan(), "poems": is_scientific_poem()} | {c: F.col("primaryCategory") == c for c in ("curricula", "academies", "literary_clubs")}
    return filtered_counts(catalog, kinds)
