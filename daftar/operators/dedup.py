"""Ordered, greedy deduplication: a row goes if a row kept before it has one of its keys or a near title."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_to_null
from .joins import anti_keys
from .near import classes, first_near, near_classes, threshold
from .near import members as titled
from .shared import dealt, discard, written

#: The name of a near title among reasons, and its number among the kinds of groups.
NEAR, NEAR_KIND = "near", -1
GROUP = ["kind", "head"]


def two_least(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi): the two least distinct values of each group; ``hi`` is null if there is one."""
    lo = rows.groupBy(*keys).agg(F.min(value).alias("lo"))
    rest = rows.join(lo, keys).filter(F.col(value) > F.col("lo")).groupBy(*keys).agg(F.min(value).alias("hi"))
    return lo.join(rest, keys, "left")


def key_groups(df: DataFrame, keys: list[Column], ord_: str) -> DataFrame:
    """(o, kind, head, looks): rows that share a key, by the key's number and its first row."""
    out = None
    for k, key in enumerate(keys):
        own = df.select(F.col(ord_).cast("long").alias("o"), empty_to_null(key).alias("key")).filter("key is not null")
        heads = own.groupBy("key").agg(F.min("o").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
        part = own.join(dealt(heads), "key").select("o", F.lit(k).alias("kind"), "head", F.lit(True).alias("looks"))
        out = part if out is None else out.unionByName(part)
    return out


def near_groups(df: DataFrame, title: str, adaptive: bool, ord_: str) -> tuple[DataFrame, DataFrame]:
    """The rows of titles that can be near another row's, as groups, and (head, before): pairs of groups of which rows of the first look at the second."""
    rows = titled(df, ord_, title)
    titles = classes(rows)
    pairs, _ = written(near_classes(titles, titles, adaptive).filter("left_class != right_class").select(F.col("left_class").cast("long").alias("head"), F.col("right_class").cast("long").alias("before")), "near")
    paired = pairs.select(F.explode(F.array("head", "before")).alias("class_id")).distinct().withColumn("paired", F.lit(True))
    looks = threshold(F.length("key"), adaptive).isNotNull()
    some = titles.join(dealt(paired), "class_id", "left").filter(F.col("paired").isNotNull() | (looks & (F.col("n_rows") > 1))).select("key", "class_id", looks.alias("looks"))
    return rows.join(dealt(some), "key").select(F.col("id").cast("long").alias("o"), F.lit(NEAR_KIND).alias("kind"), F.col("class_id").cast("long").alias("head"), "looks"), pairs


def _seen(undecided: DataFrame, kept: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(kind, head, kept, lo, hi): the first kept row and the two first undecided rows that a group's rows look at."""
    least = two_least(undecided, GROUP, "o")
    open_ = least.select(*GROUP, F.explode(F.array_compact(F.array("lo", "hi"))).alias("o"))
    first = kept
    if pairs is not None:
        other = lambda t: t.filter(F.col("kind") == NEAR_KIND).join(pairs, F.col("before") == t["head"]).select(F.lit(NEAR_KIND).alias("kind"), pairs["head"].alias("head"), *(c for c in t.columns if c not in GROUP))
        open_ = open_.unionByName(other(open_))
        first = kept.unionByName(other(kept)).groupBy(*GROUP).agg(F.min("kept").alias("kept"))
        least = two_least(open_, GROUP, "o")
    return least.join(first, GROUP, "left")


def _round(undecided: DataFrame, seen: DataFrame) -> DataFrame:
    """(o, lo, hi, kept): of each undecided row the first and last known undecided row before it, and the first kept one."""
    own = undecided.join(seen, GROUP, "left")
    mine = lambda c: F.when(F.col("looks") & (F.col(c) < F.col("o")), F.col(c))
    return own.groupBy("o").agg(F.min(mine("lo")).alias("lo"), F.max(F.coalesce(mine("hi"), mine("lo"))).alias("hi"), F.min(mine("kept")).alias("kept"))


def settle(rows: DataFrame, pointers: DataFrame) -> tuple[DataFrame, list[str]]:
    """(o, is_kept) of ``rows`` and of all that hang on them by ``pointers`` (o, to, flip), and working tables to discard: a row with one undecided row before it is the opposite of that row.

    Pointers are doubled, so a chain of any length takes as many steps as its length has binary digits.
    """
    known, paths = rows, []
    while True:
        ends = known.select(F.col("o").alias("to"), F.col("is_kept").alias("other"))
        new, path = written(pointers.join(ends, "to").select("o", (F.col("other") != F.col("flip")).alias("is_kept")), "settled")
        known = known.unionByName(new)
        far = pointers.select(F.col("o").alias("to"), F.col("to").alias("far"), F.col("flip").alias("more"))
        left = pointers.join(new.select("o"), "o", "left_anti").join(far, "to", "left")
        flip = F.when(F.col("more").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("more"))
        pointers, hop_path = written(left.select("o", F.coalesce("far", "to").alias("to"), flip.alias("flip"), F.col("far").isNotNull().alias("moved")), "hops")
        paths += [path, hop_path]
        if not pointers.filter("moved").limit(1).count():
            return known, paths
        pointers = pointers.select("o", "to", "flip")


def greedy(df: DataFrame, keys: Mapping[str, Column], near_title: str | None = None, adaptive: bool = False, ord_: str = "ord") -> DataFrame:
    """``df`` with ``kept`` and ``reason`` (``near``, or the first key in the mapping's order), as visiting rows by ``ord_`` decides.

    The relation is not transitive: what is kept is the first independent set in
    order. It is found in rounds over all groups at once. A row goes if a kept
    row is before it in one of its groups, and stays if no undecided row is; a
    row with a single undecided row before it is the opposite of that one, and
    such chains are settled by pointer doubling. Rounds read narrow (row, group)
    tables of the undecided rows; a group is only ever aggregated, so its rows
    spread over tasks. Rows without links never leave their place.
    """
    spark = df.sparkSession
    names = list(keys)
    groups, pairs = key_groups(df, list(keys.values()), ord_), None
    if near_title:
        near, pairs = near_groups(df, near_title, adaptive, ord_)
        groups = groups.unionByName(near) if groups is not None else near
    every, _ = written(groups, "groups")
    undecided, kept = every, spark.createDataFrame([], "kind int, head long, kept long")
    paths: list[str] = []
    while undecided.limit(1).count():
        state, state_path = written(_round(undecided, _seen(undecided, kept, pairs)), "state")
        now = state.filter("kept is not null or lo is null").select("o", F.col("kept").isNull().alias("is_kept"))
        hang = state.filter("kept is null and lo = hi").select("o", F.col("lo").alias("to"), F.lit(True).alias("flip"))
        settled, used = settle(now, hang)
        decided, decided_path = written(settled, "decided")
        fresh = undecided.join(decided.filter("is_kept").select("o"), "o").groupBy(*GROUP).agg(F.min("o").alias("kept"))
        kept, kept_path = written(kept.unionByName(fresh).groupBy(*GROUP).agg(F.min("kept").alias("kept")), "kept")
        undecided, left_path = written(undecided.join(decided.select("o"), "o", "left_anti"), "undecided")
        discard(spark, state_path, decided_path, *used, *paths)
        paths = [kept_path, left_path]
    reason = _reasons(every, kept, pairs, names)
    out = df.join(dealt(reason), F.col(ord_) == F.col("r_ord"), "left")
    return out.withColumn("kept", F.col("reason").isNull()).drop("r_ord")


def _reasons(every: DataFrame, kept: DataFrame, pairs: DataFrame | None, names: list[str]) -> DataFrame:
    """(r_ord, reason) of the rows that have a kept row before them."""
    first = kept
    if pairs is not None:
        over = kept.filter(F.col("kind") == NEAR_KIND).join(pairs, F.col("before") == kept["head"]).select(F.lit(NEAR_KIND).alias("kind"), pairs["head"].alias("head"), "kept")
        first = kept.unionByName(over).groupBy(*GROUP).agg(F.min("kept").alias("kept"))
    hit = every.filter("looks").join(first, GROUP).filter(F.col("kept") < F.col("o")).groupBy(F.col("o").alias("r_ord")).agg(F.min("kind").alias("kind"))
    text = F.element_at(F.array(*(F.lit(x) for x in (NEAR, *names))), F.col("kind") + 2)
    return hit.select("r_ord", text.alias("reason"))


def against_catalog(df: DataFrame, catalog: DataFrame, keys: Mapping[str, Column], near_title: str | None = None, catalog_title: str | None = None, adaptive: bool = False, ord_: str = "ord") -> DataFrame:
    """``df`` with ``existing``: null, ``exact`` or ``near``, and the place of the first near title; near wins the message."""
    fresh = anti_keys(df, catalog, keys).select(F.col(ord_).alias("f_ord"), F.lit(True).alias("fresh"))
    out = df.join(fresh, F.col(ord_) == F.col("f_ord"), "left").drop("f_ord")
    exact = F.col("fresh").isNull()
    if near_title:
        first = first_near(df.select(F.col(ord_).alias("x"), F.col(near_title).alias("t")), catalog.select(F.col("ord").alias("y"), F.col(catalog_title or near_title).alias("t")), "x", "y", "t", adaptive).select("left_id", F.col("right_id").alias("related"))
        out = out.join(first, F.col(ord_) == F.col("left_id"), "left").drop("left_id")
        return out.withColumn("existing", F.when(F.col("related").isNotNull(), "near").when(exact, "exact")).drop("fresh")
    return out.withColumn("existing", F.when(exact, "exact")).drop("fresh")
