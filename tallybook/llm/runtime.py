"""Session helpers shared by the operators: shared folder, durable tables, Arrow batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where it is unset and Spark runs in this one process (tests) a
    temporary folder is made; elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    present = sc._jsc.sc().getCheckpointDir()
    if not path and present.isDefined():
        path = present.get()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallybook-")
    if not present.isDefined():
        sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, without lineage.

    Spark's cleaner deletes the files when nothing refers to them any longer
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df computed once and marked for broadcast where it has at most so many (short) rows; beyond, Spark shuffles."""
    kept = durable(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes: texts can be long, and a row may be a whole block."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, made: list[str]) -> DataFrame:
    """df less the columns that an operator is about to make (names compare without case)."""
    taken = {c.lower() for c in made}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
