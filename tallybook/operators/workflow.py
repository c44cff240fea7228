"""Stage routing, transition and lifecycle audits, failure classes and rollups over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.values import retry_delay

# The stages in order, and the words that classify a failure.
STAGES = ["INGESTION", "PREPROCESSING", "OCR", "NORMALIZATION", "FINANCIAL_VALIDATION", "REFERENCE_MATCHING", "MEMORY_PERSISTENCE"]
TERMINAL = ["HUMAN_REVIEW", "COMPLETED"]
INTEGRITY_NAMES = ["Integrity", "HashMismatch", "Checksum", "Collision", "Tamper", "IdentityMismatch", "Isolation"]
POLICY_NAMES = ["Policy", "Approval", "Authorization", "Permission"]
PERMANENT_TEXTS = ["authentication failed", "password authentication failed", "permission denied", "does not exist", "unsupported media type", "invalid document", "invalid hash"]
PERMANENT_NAMES = ["FileNotFoundError", "PermissionError", "TypeError", "ValueError", "UnicodeError", "NotImplementedError"]
TRANSIENT_NAMES = ["OperationalError", "InterfaceError", "ConnectionError", "ConnectionTimeout", "PoolTimeout", "ReadTimeout", "WriteTimeout", "ServiceUnavailableError", "RateLimitError", "TemporaryError", "TimeoutError"]
TRANSIENT_TEXTS = ["temporarily unavailable", "connection reset", "connection refused", "connection timed out", "timeout", "too many requests", "rate limit", "service unavailable"]
JOB_MOVES = [("QUEUED", "RUNNING"), ("RUNNING", "RUNNING"), ("RUNNING", "SUCCEEDED"), ("RUNNING", "FAILED"), ("QUEUED", "FAILED")]


def failure_class(name: Column, message: Column) -> Column:
    """INTEGRITY, POLICY, PERMANENT, TRANSIENT or UNKNOWN from an error's name and message; the first rule that fits."""
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    has = lambda c, words: c.rlike("|".join(w.lower() for w in words))
    return (
        F.when(has(n, INTEGRITY_NAMES), "INTEGRITY").when(has(n, POLICY_NAMES), "POLICY").when(has(m, PERMANENT_TEXTS), "PERMANENT")
        .when(name == "AssertionError", "INTEGRITY").when(name.isin(PERMANENT_NAMES), "PERMANENT").when(name.isin(TRANSIENT_NAMES) | has(m, TRANSIENT_TEXTS), "TRANSIENT").otherwise("UNKNOWN")
    )


def route(results: DataFrame, attempts: int = 3, continue_after_review: bool = True) -> DataFrame:
    """results (stage, status, attempt, failure, review) with route, next_stage and delay."""
    s, status = F.col("stage"), F.col("status")
    place = F.array_position(F.array(*[F.lit(x) for x in STAGES]), s)
    following = F.element_at(F.array(*[F.lit(x) for x in STAGES[1:]], F.lit(None).cast("string")), F.greatest(place, F.lit(1)).cast("int"))
    retry = (status == "FAILED") & (F.col("failure") == "TRANSIENT") & (F.col("attempt") < attempts)
    last = s == "MEMORY_PERSISTENCE"
    ask = F.coalesce("review", F.lit(False))
    chosen = F.when(status == "SKIPPED", "SKIP_IDEMPOTENT").when(retry, "RETRY").when(status.isin("FAILED", "UNKNOWN") | (place == 0), "STOP_FAILED").when(last & ask, "ROUTE_TO_REVIEW").when(last, "COMPLETE")
    chosen = (chosen if continue_after_review else chosen.when(ask, "ROUTE_TO_REVIEW")).otherwise("CONTINUE")
    step = results.withColumn("route", chosen)
    r = F.col("route")
    step = step.withColumn("next_stage", F.when(r == "RETRY", s).when(r == "ROUTE_TO_REVIEW", "HUMAN_REVIEW").when(r == "COMPLETE", "COMPLETED").when(r == "CONTINUE", following))
    return step.withColumn("delay", F.when(r == "RETRY", retry_delay(F.col("attempt") + 1)).otherwise(F.lit(0.0)))


def illegal_transitions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Moves between stages that are neither a retry nor the successor; ends of the graph stay closed."""
    w = Window.partitionBy(key).orderBy(*order)
    legal = [(a, b) for a, b in zip(STAGES, STAGES[1:])] + [(a, a) for a in STAGES] + [("MEMORY_PERSISTENCE", t) for t in TERMINAL]
    ok = F.concat_ws(">", "before", "stage").isin([f"{a}>{b}" for a, b in legal])
    return rows.withColumn("before", F.lag("stage").over(w)).filter("before is not null").filter(~ok)


def illegal_job_moves(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Status changes of jobs outside the legal moves."""
    w = Window.partitionBy(key).orderBy(order)
    ok = F.concat_ws(">", "before", "status").isin([f"{a}>{b}" for a, b in JOB_MOVES])
    return events.withColumn("before", F.lag("status").over(w)).filter("before is not null").filter(~ok)


def sequence_faults(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Events whose number is not the next one of its key."""
    w = Window.partitionBy(key).orderBy(seq)
    return events.withColumn("expected", F.row_number().over(w).cast("long")).filter(F.col("expected") != F.col(seq))


def batch_rollup(rows: DataFrame) -> DataFrame:
    """rows (batch_id, outcome): counts and SUCCEEDED, COMPLETED_WITH_REVIEW, PARTIALLY_FAILED or FAILED."""
    c = lambda s: F.count_if(F.col("outcome") == s)
    out = rows.groupBy("batch_id").agg(F.count("*").alias("n"), c("SUCCEEDED").alias("succeeded"), c("REVIEW_REQUIRED").alias("review"), c("FAILED").alias("failed"), c("SKIPPED").alias("skipped"))
    status = F.when(F.col("failed") == F.col("n"), "FAILED").when(F.col("failed") > 0, "PARTIALLY_FAILED").when(F.col("review") > 0, "COMPLETED_WITH_REVIEW").otherwise("SUCCEEDED")
    return out.withColumn("status", status)


def page_flags(pages: DataFrame) -> DataFrame:
    """pages (width, height, brightness, contrast, blur, skew, dark_ratio) with flags in rule order."""
    rules = [
        F.when((F.col("width") < 500) | (F.col("height") < 700), "LOW_RESOLUTION"),
        F.when(F.col("brightness") < 35, "TOO_DARK"),
        F.when((F.col("brightness") > 235) & (F.col("dark_ratio") < 0.005), "POSSIBLY_BLANK_OR_OVEREXPOSED"),
        F.when(F.col("contrast") < 20, "LOW_CONTRAST"),
        F.when(F.col("blur") < 45, "POSSIBLE_BLUR"),
        F.when(F.abs("skew") > 15, "EXCESSIVE_SKEW"),
    ]
    return pages.withColumn("flags", F.array_compact(F.array(*rules)))


def filename_code(name: Column) -> Column:
    """The first rule an upload's file name breaks, or null."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "FILENAME_EMPTY").when(F.length(name) > 128, "FILENAME_TOO_LONG").when(name.rlike(r"[\x00-\x1f\x7f]"), "FILENAME_CONTROL_CHARACTER")
        .when(name.rlike(r"[/\\]"), "FILENAME_PATH_SEPARATOR").when(name.contains(".."), "FILENAME_TRAVERSAL").when(name != F.trim(name), "FILENAME_EDGE_SPACE")
        .when(~name.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._()-]*$"), "FILENAME_CHARACTER").when(~F.lower(name).rlike(r"\.(pdf|png|jpe?g|tiff?)$"), "FILENAME_EXTENSION")
    )


def intake_code(files: DataFrame, limit: int = 25 * 1024 * 1024) -> DataFrame:
    """binaryFile rows (path, length, content) with the first intake fault: EMPTY, TOO_LARGE, EXTENSION, SIGNATURE, MISMATCH."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tif")
    told = F.when(ext.isin("jpg", "jpeg"), "jpg").when(ext.isin("tif", "tiff"), "tif").when(ext.isin("pdf", "png"), ext)
    return files.withColumn("fault", F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > limit, "TOO_LARGE").when(told.isNull(), "EXTENSION").when(kind.isNull(), "SIGNATURE").when(kind != told, "MISMATCH"))
