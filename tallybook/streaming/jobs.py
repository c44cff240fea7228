"""Structured Streaming forms: intake, known and repeated rows, job state, counts, sinks that insert once, claims that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

LEGAL = {"": ["QUEUED"], "QUEUED": ["RUNNING", "FAILED"], "RUNNING": ["RUNNING", "SUCCEEDED", "FAILED"], "SUCCEEDED": [], "FAILED": []}


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet folder, or one file of a folder, as a stream with the schema of what is there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """First row of each key; the watermark bounds the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, events, illegal) folded from events (job_id, seq, status); illegal moves are counted, not applied."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, illegal = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for new in rows["status"]:
            n += 1
            if new in LEGAL.get(status, []):
                status = new
            else:
                illegal += 1
        state.update((status, n, illegal))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n], "illegal": [illegal]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, status string, events long, illegal long", "status string, events long, illegal long", "update", GroupStateTimeout.NoTimeout)


def counts(stream: DataFrame, column: str) -> DataFrame:
    return stream.groupBy(column).agg(F.count("*").alias("n"))


def intake(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder and those that arrive later, one row each: path, modificationTime, length, content, sha256."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is there through a Parquet sink; a repeated batch replaces its own folder, so nothing is added twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def insert_stream(stream: DataFrame, target: str, checkpoint: str, key: str, digest: str, order: str, buckets: int = 64) -> None:
    """Insert-if-absent as a sink: a key's first row goes to {target}/rows, every row's outcome to {target}/outcomes.

    NEW: the key was not there; SAME: it was, with this digest; COLLISION: with another. The target is dealt to buckets by
    the key's hash and a batch reads only those that its keys touch, so neither memory nor a stream's state grows with it.
    A repeated batch looks at earlier batches alone and replaces its own folders.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # buckets rows at most
        held = rows.sparkSession.read.schema(StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])).option("basePath", f"{target}/rows")
        first = Window.partitionBy(key).orderBy(order, digest)
        ranked = rows.withColumn("_r", F.row_number().over(first)).withColumn("_first", F.first(digest).over(first))
        if batch_id:
            known = held.parquet(f"{target}/rows").filter((F.col("batch") < batch_id) & F.col("bucket").isin(touched)).select(F.col(key).alias("_key"), F.struct(F.col(digest).alias("digest")).alias("_held"))
            ranked = ranked.join(known, ranked[key] == known["_key"], "left").drop("_key")
        else:
            ranked = ranked.withColumn("_held", F.lit(None).cast(StructType([StructField("digest", schema[digest].dataType)])))
        there = F.coalesce(F.col("_held"), F.when(F.col("_r") > 1, F.struct(F.col("_first").alias("digest"))))
        outcome = F.when(there.isNull(), "NEW").when(there["digest"].eqNullSafe(F.col(digest)), "SAME").otherwise("COLLISION")
        told = ranked.withColumn("outcome", outcome).persist()
        told.filter("outcome = 'NEW'").select(*schema.names, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/batch={batch_id}")
        told.select(key, order, "outcome").write.mode("overwrite").parquet(f"{target}/outcomes/batch={batch_id}")
        told.unpersist()
        rows.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def flagged_known(stream: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """Every row of the stream with duplicate: its digest is among the known ones, a table that each batch reads anew."""
    there = known.select(F.col(digest).alias("_known")).filter("_known is not null").distinct()
    return stream.join(there, stream[digest] == there["_known"], "left").withColumn("duplicate", F.col("_known").isNotNull()).drop("_known")


def claim_timeouts(events: DataFrame, seconds: int = 1800, delay: str = "0 seconds", order: str | None = None) -> DataFrame:
    """(case_id, claimed_at, expired_at) of claims that no later event of their case ended in time.

    events: case_id, status, at, and the column named in order, which ranks a case's events of the same second (without it
    they are taken as they arrive, which a shuffle does not keep). Timers are set in event time, so a replay expires the
    same claims; only open claims are held as state.
    """
    ranks = ["at"] if order is None else ["at", order]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        claimed = state.get[0] if state.exists else None
        if state.hasTimedOut:
            done.append((claimed, claimed + seconds))
            claimed = None
        else:
            for row in pd.concat(list(batches)).sort_values(ranks, kind="stable").itertuples():
                at = int(row.at.timestamp())
                if claimed is not None and at > claimed + seconds:
                    done.append((claimed, claimed + seconds))
                claimed = at if row.status == "CLAIMED" else None
        if claimed is None:
            state.remove()
        elif (claimed + seconds) * 1000 <= state.getCurrentWatermarkMs():
            done.append((claimed, claimed + seconds))
            state.remove()
        else:
            state.update((claimed,))
            state.setTimeoutTimestamp((claimed + seconds) * 1000 - 1)  # a timer goes off behind its time, a claim ends at it
        yield pd.DataFrame({"case_id": [key[0]] * len(done), "claimed_at": [pd.Timestamp(a, unit="s") for a, _ in done], "expired_at": [pd.Timestamp(b, unit="s") for _, b in done]})

    marked = events.withWatermark("at", delay)
    return marked.groupBy("case_id").applyInPandasWithState(fold, "case_id long, claimed_at timestamp, expired_at timestamp", "claimed long", "append", GroupStateTimeout.EventTimeTimeout)


def last_states(updates: DataFrame, key: str = "job_id") -> DataFrame:
    """Of rows that an update-mode stream has drained (with batch), the last of each key."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in (key, "batch")]), "batch").alias("_s")).select(key, "_s.*")


def stale_claims(cases: DataFrame, now: str, seconds: int = 1800) -> DataFrame:
    """Claims older than so many seconds at a given time."""
    return cases.filter((F.col("status") == "CLAIMED") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("claimed_at") > seconds))
