"""Facet and category counts that follow a changing catalog: each change is counted by itself and added to what is kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import discard, new_path

COUNTS = "dimension string, value string, n long"


def offers(df: DataFrame, dimensions: Sequence[str], conditions: dict[str, Column], sign: int) -> DataFrame:
    """(dimension, value, n) of a change: one pass, each row offers its facets' values and the categories that it meets."""
    facets = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    groups = [F.when(c, F.struct(F.lit("category").alias("dimension"), F.lit(k).alias("value"))) for k, c in conditions.items()]
    each = df.select(F.explode(F.array_compact(F.array(*facets, *groups))).alias("o"))
    return each.groupBy("o.dimension", "o.value").agg((F.count("*") * sign).alias("n"))


@dataclass
class Counts:
    """Counts of facet values and overlapping categories in the shared folder, a version for each change.

    A change reads its own rows and the counts, never the catalog, so its work
    follows the change and the number of different values. Retracted rows are
    given as they were inserted. A version is written whole before it is named
    as the current one, so a change that fails leaves the counts as they were;
    a change that has been applied before, by its number, is left out.
    """

    spark: SparkSession
    dimensions: Sequence[str]
    conditions: dict[str, Column]
    applied: int = 0
    path: str | None = field(default=None)

    def table(self) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(self.path) if self.path else self.spark.createDataFrame([], COUNTS)

    def apply(self, number: int, inserted: DataFrame | None = None, retracted: DataFrame | None = None) -> None:
        """Change ``number`` (1, 2, ...): rows that came and rows that went."""
        if number <= self.applied:
            return
        if number != self.applied + 1:
            raise ValueError(f"change {number} follows change {self.applied}")
        out = self.table()
        for df, sign in ((inserted, 1), (retracted, -1)):
            if df is not None:
                out = out.unionByName(offers(df, self.dimensions, self.conditions, sign))
        merged = out.groupBy("dimension", "value").agg(F.sum("n").alias("n")).filter("n != 0")
        before, path = self.path, new_path(self.spark, "counts")
        merged.write.parquet(path)
        self.path, self.applied = path, number
        if before:
            discard(self.spark, before)

    def follow(self, batch: DataFrame, batch_id: int, change: str = "change") -> None:
        """For ``foreachBatch``: rows with ``change`` 'insert' or 'retract'; a batch that Spark repeats counts once."""
        self.apply(batch_id + 1, batch.filter(F.col(change) == "insert"), batch.filter(F.col(change) == "retract"))
