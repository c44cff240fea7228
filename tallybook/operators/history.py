"""Evidence, stored payloads and histories: indexes and searches, projections, appends, integrity of resumed work."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DecimalType, StructType, TimestampType

from tallybook.functions.text import comparison_key, uuid5
from tallybook.sources.shared import kept


def _none() -> Column:
    return F.array().cast("array<string>")


# ---- evidence -------------------------------------------------------------------------------


def evidence_index(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens and lines (document_id, reference_id, page, reading_order, text) as one index, by page and order, with fault:
    DUPLICATE_REFERENCE for every holder of an id that a document has twice, PAGE_BELOW_ONE."""
    columns = ["document_id", "reference_id", "page", "reading_order", "text"]
    both = tokens.select(*columns, F.lit("TOKEN").alias("reference_type")).union(lines.select(*columns, F.lit("LINE").alias("reference_type")))
    n = F.count("*").over(Window.partitionBy("document_id", "reference_id"))
    fault = F.when(n > 1, "DUPLICATE_REFERENCE").when(F.col("page") < 1, "PAGE_BELOW_ONE")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "reading_order", "reference_id"))
    return both.withColumn("fault", fault).withColumn("place", place)


def find_evidence(index: DataFrame, text: str, exact: bool = False, reference_type: str | None = None) -> DataFrame:
    """References whose comparison key equals or contains that of a text; none for a text without a key."""
    wanted = comparison_key(F.lit(text))
    key = comparison_key(F.col("text"))
    out = index.filter((wanted != "") & (key == wanted if exact else key.contains(wanted)))
    return out if reference_type is None else out.filter(F.col("reference_type") == reference_type)


def unknown_evidence(corrections: DataFrame, cases: DataFrame) -> DataFrame:
    """corrections (case_id, evidence) with unknown: the ids that their case's evidence does not hold."""
    held = cases.select("case_id", F.col("evidence").alias("_held"))
    j = corrections.join(held, "case_id", "left")
    return j.withColumn("unknown", F.array_except(F.coalesce("evidence", _none()), F.coalesce("_held", _none()))).drop("_held")


# ---- boxes ----------------------------------------------------------------------------------


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """struct(x, y, w, h), none of them below 0."""
    zero = F.lit(0)
    x, y = F.greatest(left, zero), F.greatest(top, zero)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(right - x, zero).alias("w"), F.greatest(bottom - y, zero).alias("h"))


def union_boxes(boxes: DataFrame, keys: list[str], column: str = "box") -> DataFrame:
    """The least box around all boxes of a key."""
    b = F.col(column)
    g = boxes.groupBy(*keys).agg(F.min(b["x"]).alias("_x"), F.min(b["y"]).alias("_y"), F.max(b["x"] + b["w"]).alias("_r"), F.max(b["y"] + b["h"]).alias("_b"))
    return g.select(*keys, box(F.col("_x"), F.col("_y"), F.col("_r"), F.col("_b")).alias(column))


def inside(b: Column, width: Column, height: Column) -> Column:
    return (b["x"] >= 0) & (b["y"] >= 0) & (b["x"] + b["w"] <= width) & (b["y"] + b["h"] <= height)


# ---- stored payloads ------------------------------------------------------------------------

FIELD_PAYLOAD = "fields array<struct<field_name:string,value:string,confidence:double,evidence:array<string>>>"
MATCH_PAYLOAD = "line_matches array<struct<line_number:int,po_line_number:int,score:double,status:string>>"


def fields_of(payloads: DataFrame, schema: str = FIELD_PAYLOAD) -> DataFrame:
    """Stored payloads (key, payload) as field rows, each evidence id once."""
    rows = payloads.select("key", F.posexplode(F.from_json("payload", schema)["fields"]).alias("position", "f"))
    return rows.select("key", "position", "f.field_name", "f.value", "f.confidence", F.array_distinct(F.coalesce("f.evidence", _none())).alias("evidence"))


def line_matches_of(payloads: DataFrame, schema: str = MATCH_PAYLOAD) -> DataFrame:
    """Stored payloads (key, payload) as line-match rows; a key without matches keeps one row of nulls."""
    return payloads.select("key", F.inline_outer(F.from_json("payload", schema)["line_matches"]))


def correctable_values(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(document_id, line_number, field_name, value): line columns as rows, by line and field; a nested value gives its value."""
    value = lambda c: F.col(f"{c}.value") if isinstance(lines.schema[c].dataType, StructType) else F.col(c)
    pairs = F.array(*[F.struct(F.lit(f.upper()).alias("field_name"), value(f).cast("string").alias("value")) for f in sorted(fields)])
    return lines.select("document_id", "line_number", F.inline(pairs))


def json_safe(df: DataFrame) -> DataFrame:
    """df with decimals in plain notation, dates and times as ISO text, also inside structs and arrays of structs."""

    def safe(c: Column, kind) -> Column:
        if isinstance(kind, (DecimalType, DateType)):
            return c.cast("string")
        if isinstance(kind, TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in kind]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: safe(x, kind.elementType))
        return c

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def content_hash(df: DataFrame, leave_out: tuple[str, ...] = ("created_at", "occurred_at")) -> Column:
    """Hash of a row's content, keys sorted, without the times at which it was made, at any depth."""

    def bare(c: Column, kind) -> Column:
        if isinstance(kind, StructType):
            kept = sorted((f for f in kind if f.name not in leave_out), key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*[bare(c[f.name], f.dataType).alias(f.name) for f in kept]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: bare(x, kind.elementType))
        return c.cast("string") if isinstance(kind, (DecimalType, DateType, TimestampType)) else c

    kept = sorted((f for f in df.schema if f.name not in leave_out), key=lambda f: f.name)
    return F.sha2(F.to_json(F.struct(*[bare(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kept]), {"ignoreNullFields": "false"}), 256)


# ---- identities -----------------------------------------------------------------------------


def batch_id(namespace: uuid.UUID, source: Column, reference: Column) -> Column:
    """Identity of a batch from its source and reference, without case and outer space; null without a reference."""
    plain = lambda c: F.lower(F.trim(c))
    return F.when(F.coalesce(plain(reference), F.lit("")) != "", uuid5(namespace, F.concat_ws(":", plain(source), plain(reference))))


def command_fingerprint(corrections: Column, evidence: Column, reasons: Column, **scalars: Column) -> Column:
    """Hash of a command: its scalars by name, and its lists in sorted order, so that their order does not matter."""
    lists = {"corrections": corrections, "evidence": evidence, "reasons": reasons}
    parts = {n: c.cast("string") for n, c in scalars.items()} | {n: F.array_sort(F.coalesce(c, _none())) for n, c in lists.items()}
    return F.sha2(F.to_json(F.struct(*[parts[n].alias(n) for n in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def resume_plan(decisions: DataFrame, namespace: uuid.UUID) -> DataFrame:
    """decisions (decision_id, overlay) with the overlay's hash, the plan's identity and its version label."""
    digest = F.sha2(F.coalesce("overlay", F.lit("")), 256)
    return decisions.withColumn("overlay_hash", digest).withColumn("plan_id", uuid5(namespace, F.concat(F.lit("resume|"), F.col("decision_id").cast("string")))).withColumn("version", F.substring(digest, 1, 16))


# ---- histories ------------------------------------------------------------------------------


def append_history(stored: DataFrame, incoming: DataFrame, stream: str, key: str, digest: str, order: list[str]) -> DataFrame:
    """Incoming rows with outcome (NEW, SAME, COLLISION, the last for another content under a key) and, if new, the next
    sequence numbers of their stream, in order; of equal new keys the first is appended."""
    held = stored.select(F.col(key).alias("_key"), F.col(digest).alias("_digest")).dropDuplicates(["_key"])
    last = stored.groupBy(F.col(stream).alias("_stream")).agg(F.max("sequence").alias("_last"))
    again = Window.partitionBy(key).orderBy(*order)
    j = incoming.join(held, incoming[key] == held["_key"], "left").withColumn("_first", F.first(digest).over(again)).withColumn("_n", F.row_number().over(again))
    known = F.when(F.col("_key").isNotNull(), F.col("_digest")).when(F.col("_n") > 1, F.col("_first"))
    outcome = F.when(F.col("_key").isNull() & (F.col("_n") == 1), "NEW").when(known.eqNullSafe(F.col(digest)), "SAME").otherwise("COLLISION")
    j = j.withColumn("outcome", outcome).join(last, F.col(stream) == F.col("_stream"), "left")
    step = F.row_number().over(Window.partitionBy(stream, "outcome").orderBy(*order))
    return j.withColumn("sequence", F.when(F.col("outcome") == "NEW", F.coalesce("_last", F.lit(0)) + step)).select(*incoming.columns, "outcome", "sequence")


def append_versions(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived versions (document_id, parent_version, digest, status, created_at) to append to stored (document_id, version,
    digest): with number, whether a new review case is due, and fault PARENT_MISSING, PARENT_NOT_LATEST or STATUS_NOT_FINAL."""
    latest = stored.groupBy(F.col("document_id").alias("_d")).agg(F.max("version").alias("_latest"), F.collect_set("version").alias("_all"))
    j = derived.join(latest, F.col("document_id") == F.col("_d"), "left")
    fault = F.when(~F.coalesce(F.array_contains("_all", F.col("parent_version")), F.lit(False)), "PARENT_MISSING").when(F.col("parent_version") != F.col("_latest"), "PARENT_NOT_LATEST").when(~F.col("status").isin("SUCCEEDED", "REVIEW_REQUIRED"), "STATUS_NOT_FINAL")
    return j.withColumn("fault", fault).withColumn("version", F.when(fault.isNull(), F.col("_latest") + 1)).withColumn("new_case", fault.isNull() & (F.col("status") == "REVIEW_REQUIRED")).drop("_d", "_latest", "_all")


def resume_faults(plans: DataFrame, decisions: DataFrame, workflows: DataFrame, memory: DataFrame) -> DataFrame:
    """(plan_id, fault): the first integrity fault of each resume plan against its decision, workflow and stored memory."""
    d = decisions.select(F.col("decision_id").alias("_did"), F.col("case_id").alias("_dcase"), F.col("disposition").alias("_disposition"), F.sha2(F.coalesce("overlay", F.lit("")), 256).alias("_overlay"))
    w = workflows.select(F.col("workflow_id").alias("_wid"), F.col("tenant_id").alias("_wtenant"), F.col("document_id").alias("_wdoc"), F.col("status").alias("_wstatus"))
    m = memory.select(F.col("document_id").alias("_mdoc"), F.col("payload").alias("_payload"), F.col("payload_sha256").alias("_digest"), F.col("tenant_id").alias("_mtenant"))
    j = plans.join(d, F.col("decision_id") == F.col("_did"), "left").join(w, F.col("workflow_id") == F.col("_wid"), "left").join(m, F.col("document_id") == F.col("_mdoc"), "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules = [
        (F.col("_did").isNull(), "DECISION_MISSING"), (differs("case_id", "_dcase"), "DECISION_CASE_MISMATCH"), (~F.coalesce(F.col("_disposition").isin("APPROVED", "CORRECTED"), F.lit(False)), "DECISION_NOT_RESUMABLE"), (differs("overlay_hash", "_overlay"), "OVERLAY_HASH_MISMATCH"),
        (F.col("_wid").isNull(), "WORKFLOW_MISSING"), (differs("tenant_id", "_wtenant"), "WORKFLOW_TENANT_MISMATCH"), (differs("document_id", "_wdoc"), "WORKFLOW_DOCUMENT_MISMATCH"), (F.col("_wstatus") != "REVIEW_REQUIRED", "WORKFLOW_NOT_UNDER_REVIEW"),
        (F.col("_mdoc").isNull(), "MEMORY_MISSING"), (differs("tenant_id", "_mtenant"), "MEMORY_TENANT_MISMATCH"), (~F.col("_digest").eqNullSafe(F.sha2("_payload", 256)), "MEMORY_HASH_MISMATCH"), (differs("memory_sha256", "_digest"), "MEMORY_CHANGED"),
    ]
    return j.select("plan_id", F.coalesce(*[F.when(bad, F.lit(code)) for bad, code in rules]).alias("fault"))


# ---- reads ----------------------------------------------------------------------------------


def job_page(jobs: DataFrame, page: int = 1, size: int = 25, **filters) -> DataFrame:
    """Jobs, the latest first; filters that are None are not applied."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    for column, value in filters.items():
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).offset((page - 1) * size).limit(size)


def timeline(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each case's events (sequence, occurred_at, event_id), then its decisions (decided_at, decision_id), with their place."""
    a = events.select("case_id", F.lit(0).alias("_kind"), "sequence", F.col("occurred_at").alias("at"), F.col("event_id").cast("string").alias("id"))
    b = decisions.select("case_id", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("sequence"), F.col("decided_at").alias("at"), F.col("decision_id").cast("string").alias("id"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("_kind", "sequence", "at", "id"))
    return a.union(b).withColumn("place", place).withColumn("kind", F.when(F.col("_kind") == 0, "EVENT").otherwise("DECISION")).drop("_kind")


def case_memory(cases: DataFrame, original: DataFrame, versions: DataFrame, columns: list[str]) -> DataFrame:
    """Each case beside its document's values: those of the version that the case names, else the original ones."""
    v = versions.select(F.col("version_id").alias("_vid"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = cases.join(original.select("document_id", *columns), "document_id").join(v, F.col("version_id") == F.col("_vid"), "left")
    return j.select(*[cases[c] for c in cases.columns if c != "document_id"], "document_id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in columns], F.col("_vid").isNotNull().alias("revised"))


def workflow_memory(original: DataFrame, versions: DataFrame, columns: list[str]) -> DataFrame:
    """Each document's values by its latest version (by time, then id), else the original ones."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("version_id"))
    last = versions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("document_id").alias("_d"), F.col("version_id").alias("effective_version"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = original.join(last, F.col("document_id") == F.col("_d"), "left")
    return j.select("document_id", "effective_version", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in columns])


def identity(mappings: DataFrame, organisations: DataFrame) -> DataFrame:
    """(subject, tenant_id, role) of active mappings to active organisations."""
    active = organisations.filter("status = 'ACTIVE'").select("tenant_id")
    return mappings.filter("status = 'ACTIVE'").join(active, "tenant_id").select("subject", "tenant_id", "role")


def reference_snapshot(matches: DataFrame, suppliers: DataFrame, orders: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each match (document_id, supplier_id, po_key) with the supplier's name, the order's number and its receipts, nulls where unmatched."""
    held = receipts.groupBy("po_key").agg(F.array_sort(F.collect_list("goods_receipt_id")).alias("receipts"))
    s = suppliers.select("supplier_id", "legal_name").dropDuplicates(["supplier_id"])
    return matches.join(s, "supplier_id", "left").join(orders.select("po_key", "po_number"), "po_key", "left").join(held, "po_key", "left").select("document_id", "legal_name", "po_number", F.coalesce("receipts", _none()).alias("receipts"))


def by_position(results: DataFrame, position: str = "input_position") -> DataFrame:
    """Results in the order of their input."""
    return results.orderBy(F.col(position).asc_nulls_last())


def numbered(rows: DataFrame, position: str = "input_position", name: str = "place") -> DataFrame:
    """rows with their place from 0 in the order of position: a place within its range of positions plus the sizes of the
    ranges before, so no task sees all rows."""
    held = kept(by_position(rows, position).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_before") + F.col("_m") - F.shiftleft("_part", 33)
    return held.withColumn("_part", part).join(before, "_part").withColumn(name, place).drop("_m", "_part", "_before")
