"""Joins of the catalog: keyed anti-joins, ordered unions, first reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_to_null
from .shared import written


def keys_of(df: DataFrame, key: Column) -> DataFrame:
    return df.select(empty_to_null(key).alias("_key")).filter("_key is not null").distinct()


def anti_keys(df: DataFrame, against: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Rows of ``df`` that share none of ``keys`` with ``against``; empty keys never match.

    One anti-join per key: a single join on an OR of keys would compare all pairs.
    """
    out = df
    for name, key in keys.items():
        column = f"_k_{name}"
        out = out.withColumn(column, empty_to_null(key)).join(keys_of(against, key), F.col(column) == F.col("_key"), "left_anti").drop(column)
    return out


def prioritized_union(batches: Sequence[DataFrame], keys: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Batches in order, each without rows that share a key with what was accepted before it.

    ``keys[0]`` is ignored: the first batch is taken whole. Rows of one batch
    never remove each other. A key's name stands for one expression in all
    batches. Each batch's accepted rows are written with their keys, so a step
    scans the keys before it once, and plans stay the same size however many
    batches there are.
    """
    spark, columns = batches[0].sparkSession, batches[0].columns
    every = {name: key for by in reversed(keys) for name, key in by.items()}
    paths: list[str] = []
    for batch, by in zip(batches, keys, strict=True):
        own = batch.select(*columns, *(empty_to_null(key).alias(f"_k_{name}") for name, key in every.items()))
        for name in by if paths else ():
            column = f"_k_{name}"
            taken = spark.read.schema(own.schema).parquet(*paths).select(F.col(column).alias("_key")).filter("_key is not null").distinct()
            own = own.join(taken, F.col(column) == F.col("_key"), "left_anti")
        accepted, path = written(own, "batch")
        paths.append(path)
    return spark.read.schema(accepted.schema).parquet(*paths).select(*columns)


def flag(df: DataFrame, against: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with ``name``: whether the key occurs in ``against``."""
    known = keys_of(against, key).select(F.col("_key").alias(f"_{name}"), F.lit(True).alias(name))
    return df.withColumn(f"_own_{name}", empty_to_null(key)).join(known, F.col(f"_own_{name}") == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(f"_own_{name}", f"_{name}")


def first_reason(df: DataFrame, against: DataFrame, keys: Mapping[str, Column], name: str = "reason") -> DataFrame:
    """The first key, in order, that a row shares with ``against``; null if none."""
    out = df
    for k, key in keys.items():
        out = flag(out, against, key, f"_hit_{k}")
    reason = F.coalesce(*(F.when(F.col(f"_hit_{k}"), F.lit(k)) for k in keys))
    return out.withColumn(name, reason).drop(*(f"_hit_{k}" for k in keys))


def lookup(df: DataFrame, side: DataFrame, on: str, how: str = "left") -> DataFrame:
    return df.join(side, on, how)


def collision_tally(df: DataFrame, against: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """How many rows collide on each key, on any, and on none."""
    out = df
    for k, key in keys.items():
        out = flag(out, against, key, f"_hit_{k}")
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.col(f"_hit_{k}")
    return out.agg(*(F.count_if(F.col(f"_hit_{k}")).alias(f"by_{k}") for k in keys), F.count_if(hit).alias("any_key"), F.count_if(~hit).alias("no_key"))


def common_keys(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Number of distinct keys on both sides."""
    return keys_of(left, key).intersect(keys_of(right, key)).agg(F.count("*").alias("n"))


def overlap(left: DataFrame, right: DataFrame, on: str = "id") -> DataFrame:
    """Number of rows of ``left`` whose key ``right`` has too."""
    return left.join(right.select(on), on, "left_semi").agg(F.count("*").alias("n"))


def retract(current: DataFrame, added_before: DataFrame, eligible: DataFrame, on: str = "id") -> DataFrame:
    """``current`` without rows that were added before and are no longer eligible."""
    gone = added_before.select(on).distinct().join(eligible.select(on), on, "left_anti")
    return current.join(gone, on, "left_anti")
