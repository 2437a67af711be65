"""Shared working folders: lineage is cut by writing a table where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to a Python worker at once: with long texts the number of rows alone bounds nothing.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size if need be, for results that are computed after an operator has returned."""
    now = spark.conf.get(BATCH, None)
    if not now or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a session on one machine that names none (tests) gets a temporary one."""
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} is not set: on {master} working tables need a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="daftar-")
        spark.conf.set(CHECKPOINT_DIR, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/daftar-{tag}-{uuid.uuid4().hex}"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files behind."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


#: Parquet's writer counts what it holds from its 100th row on, and a reader takes a row group at once: for rows of megabytes both are told to look at every row.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, tag: str, large_rows: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and return it as read back, with its path. Tables of ``large_rows`` are held a few rows at a time."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    small_batches(spark)
    with cleaned_up(spark):
        df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove working tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
