"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset and Spark runs in this one process (tests) a
    temporary folder is made; elsewhere an unset folder is an error."""
    context = spark.sparkContext
    path, present = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    path = path or (present.get() if present.isDefined() else None)
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallybook-")
    if not present.isDefined():
        context.setCheckpointDir(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df for joins of both sides by their keys. Files are small where columns repeat or compress well, so by their size
    Spark would send tables that grow with the input through the driver to every executor."""
    return df.hint("merge")


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, worked out once and kept as compressed columns in the shared folder until this application ends."""
    path = fresh_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return spread(df.sparkSession.read.parquet(path))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted with everything in it when this application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4()}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def few(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """The rows of df, kept, and marked for broadcast where they are at most so many."""
    path = fresh_folder(df.sparkSession, "few")
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    return out.hint("broadcast") if out.limit(rows + 1).count() <= rows else spread(out)
