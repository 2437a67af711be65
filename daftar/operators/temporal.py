"""Joins in time: points to the intervals that hold them, and rows to the last earlier row of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt, written


def _level(length: Column) -> Column:
    """The least l with 2^l >= length, exactly: the binary digits of length - 1."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with each interval [start, end) of its keys that holds it; whole numbers of any unit.

    An interval is binned by the power of two next to its length, so it lies in
    two bins at most however long it is; a point looks into one bin of each
    length that occurs (64 at most). Bins join by equality, and a pair meets
    once. Empty and reversed intervals hold nothing; null bounds and null keys
    match nothing. Columns of both sides but the keys must differ by name.
    """
    sized = intervals.filter(F.col(start) < F.col(end)).withColumn("_level", _level(F.coalesce(F.try_subtract(F.col(end).cast("long"), F.col(start).cast("long")), F.lit(2**63 - 1))))
    levels = sorted(r[0] for r in sized.select("_level").distinct().limit(65).collect())
    if not levels:
        return points.join(intervals.limit(0), keys)
    bin_of = lambda t, level: F.call_function("shiftright", t.cast("long"), level)
    binned = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col(start), F.col("_level")), bin_of(F.col(end) - 1, F.col("_level"))))))
    looking = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", bin_of(F.col(at), F.col("_level")))
    met = looking.join(dealt(binned), [*keys, "_level", "_bin"])
    return met.filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], order: str) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` with its keys that is not later, the largest ``order`` among equals; null if there is none.

    Both sides are merged by one range sort over keys and time, and the last
    right row is carried along; a partition begins with what earlier partitions
    hold of its first keys. So a key of any size takes as many tasks as it has
    partitions, and no pairs are made. Left rows with a null key or time match nothing.
    """
    place = F.lit(None).cast("struct<" + ",".join(f"{v}:{right.schema[v].dataType.simpleString()}" for v in values) + ">")
    own = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_order"), place.alias("_value"), F.struct(*left.columns).alias("_row"))
    other = right.filter(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(order).alias("_order"), F.struct(*values).alias("_value"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    dealt = own.unionByName(other).repartitionByRange(*keys, "_at", "_side", "_order").withColumn("_part", F.spark_partition_id())
    parts, _ = written(dealt, "merged")
    before = Window.partitionBy("_part", *keys).orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("_hit", F.last("_value", ignorenulls=True).over(before)).filter("_side = 1")
    last = parts.filter("_side = 0").groupBy(*keys, "_part").agg(F.max_by("_value", F.struct("_at", "_order")).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_part").distinct().join(last, [*keys, "_part"], "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
    carried = carried.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), "_carried")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    out = found.join(carried, same, "left").withColumn("_value", F.when(F.col("_at").isNotNull(), F.coalesce("_hit", "_carried")))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return out.withColumn("_value", F.when(~missing, F.col("_value"))).select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))
