"""Sums of fixed-size vectors over all rows: each task adds up its rows, and tasks' vectors are added in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Vectors that one task of the tree adds, and so the most that reach the driver.
FAN = 32


def _add(table: pa.Table) -> pa.Table:
    vectors = [np.frombuffer(raw.as_buffer(), np.float64) for raw in table["total"]]
    total = np.sum(vectors, axis=0)
    return pa.table({"slot": pa.array([table["slot"][0].as_py()], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})


def partition_sum(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """``add(batch, total)`` adds a batch's rows to a vector of ``size`` doubles; returns the sum over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                add(batch, total)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    rows, path = materialize(df.mapInArrow(run, "slot long, total binary"), "sums")
    while rows.count() > FAN:
        merged, merged_path = materialize(rows.withColumn("slot", F.floor(F.col("slot") / FAN)).groupBy("slot").applyInArrow(_add, "slot long, total binary"), "sums")
        discard(df.sparkSession, path)
        rows, path = merged, merged_path
    total = np.zeros(size)
    for row in rows.select("total").toLocalIterator():
        total += np.frombuffer(bytes(row[0]), np.float64)
    discard(df.sparkSession, path)
    return total


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)
