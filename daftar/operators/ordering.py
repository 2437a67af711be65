"""Sorts, pages, samples and windows. Order is always a column, never the place of a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from .shared import written

PAGE_SIZE = 12


def collated(column: Column, collation: str = "ar") -> Column:
    return F.collate(column, collation)


def title_order(df: DataFrame, title: str = "title", ord_: str = "ord") -> DataFrame:
    return df.orderBy(collated(F.col(title)), ord_)


def thesis_order(df: DataFrame) -> DataFrame:
    """Level (doctorate, master, other), then second tag, then title."""
    level = F.element_at(F.col("tags"), 1)
    rank = F.when(level == "دكتوراه", 0).when(level == "ماجستير", 1).otherwise(2)
    return df.orderBy(rank, collated(F.coalesce(F.try_element_at("tags", F.lit(2)), F.lit(""))), collated(F.col("title")), "ord")


def first_if(df: DataFrame, wanted: Column, *then: str) -> DataFrame:
    """Rows of a priority first; otherwise the given order (a stable sort)."""
    return df.orderBy(F.when(wanted, 0).otherwise(1), *(then or ("ord",)))


def by_count(df: DataFrame, n: str = "n") -> DataFrame:
    """Largest counts first: ``_less`` is the column to sort by."""
    return df.withColumn("_less", -F.col(n))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    number: int
    count: int


def page(df: DataFrame, number: int, *order: str, size: int = PAGE_SIZE) -> Page:
    """Page ``number`` (from 1, clamped) in a total order."""
    count = max(1, -(-df.count() // size))
    number = min(max(number, 1), count)
    return Page(df.orderBy(*order).offset((number - 1) * size).limit(size), number, count)


def prefix_sample(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, key: str, modulus: int = 37, most: int | None = 120, ord_: str = "ord") -> DataFrame:
    """Rows whose key's FNV-1a hash is a multiple of ``modulus``."""
    some = df.filter(fnv1a(F.col(key)) % modulus == 0)
    return some if most is None else some.orderBy(ord_).limit(most)


def systematic_sample(df: DataFrame, ord_: str, most: int = 40) -> DataFrame:
    """Every n/most-th row in order.

    Row numbers come from per-partition counts after a range sort, so no task
    holds all rows.
    """
    n = df.count()
    stride = max(1, n // most)
    return row_numbers(df, ord_).filter((F.col("row_number") % stride) == 0).filter(F.col("row_number") < stride * most).drop("row_number")


def row_numbers(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """Rows numbered from 0 in a total order, without a window over one partition.

    The rows are range-partitioned; partition sizes (one number each) give every
    partition its offset.
    """
    # written, since a partition's number must be the same wherever it is read
    parts, _ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "parts")
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = parts.withColumn("_at", F.row_number().over(inside) - 1)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return numbered.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_p", "_at", "_before")


def first_per_group(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def running_sum(df: DataFrame, value: Column, group: list[str], *order: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over this and earlier rows of its group in a total order.

    Groups may be few and large: rows are range-partitioned by group and order,
    and each partition adds what earlier partitions hold of its groups (one
    number for each).
    """
    keys = [F.col(g) for g in group]
    parts, _ = written(df.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "parts")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("_part", *group).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g_{g}") for g in group), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = parts.withColumn("_run", F.sum("_value").over(inside)).join(before, same)
    return out.withColumn(name, F.col("_run") + F.col("_before")).select(*df.columns, name)


def seen_before(keys: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1
