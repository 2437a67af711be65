"""Steps whose result is written where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


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


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as read back from a table in the shared folder, and the table's path."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame) -> DataFrame:
    """``df``, whose next join deals both sides by key.

    Spark guesses a table's size from its files and takes an exploded row for
    one row: it would gather millions of rows in the driver and send them to all executors.
    """
    return df.hint("merge")


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove working tables that no later plan reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    It also ends an expression tree: columns that later rules read many times
    are computed once.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
