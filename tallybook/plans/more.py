"""Queries on phase results, extraction, memory records and resumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import extract as X
from tallybook.operators import results as P
from tallybook.plans import finance
from tallybook.plans.records import _read, _sql
from tallybook.sources.derived import derived, with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return register


@query("""select event_id, case event_type when 'signup' then 'SKIPPED' when 'view' then 'SUCCEEDED' when 'click' then 'REVIEW_REQUIRED' when 'error' then 'FAILED' else 'ODD' end as status, event_type = 'click' or event_id % 5 = 0 as review from events""")
def status_normaliser(spark, sf):
    e = _read(spark, sf, "events")
    word = F.when(F.col("event_type") == "signup", " duplicate ").when(F.col("event_type") == "view", "Created").when(F.col("event_type") == "click", "review_required").when(F.col("event_type") == "error", "Conflict").otherwise("odd")
    status = P.status_of(F.lit(" "), F.lit(None).cast("string"), word)
    return e.select("event_id", status.alias("status"), P.needs_review(status, F.when(F.col("event_id") % 5 == 0, True)).alias("review"))


@query("select user_id, event_type as status, count(*) as n from events group by all")
def check_projection(spark, sf):
    one = F.struct(F.lit("CHECK").alias("check_type"), F.col("event_type").alias("status"), F.array(F.struct(F.lit("a").alias("name"), F.array(F.lit("e1"), F.lit("e1")).alias("evidence"))).alias("operands"))
    p = _read(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.to_json(F.struct(F.collect_list(one).alias("checks"))).alias("payload"))
    rows = P.checks_of(p).filter("size(evidence) = 1")
    return rows.groupBy(F.col("key").alias("user_id"), "status").agg(F.count("*").alias("n"))


@query("""select event_id, case event_id % 7 when 1 then 'UNKNOWN_KEY' when 2 then 'MISSING_KEY' when 3 then 'NOT_AN_OBJECT' when 4 then 'ROUND_TRIP' when 5 then 'ROUND_TRIP' end as fault from events""")
def strict_json(spark, sf):
    k, i = F.col("event_id") % 7, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"a":"'), i, F.lit('","b":null}'))).when(k == 1, F.lit('{"a":"1","c":2}')).when(k == 2, F.lit('{"b":"1"}')).when(k == 3, F.lit("[1]"))
    text = text.when(k == 4, F.concat(F.lit('{"a":'), i, F.lit(',"b":null}'))).when(k == 5, F.lit('{"a":true,"b":"x"}')).otherwise(F.concat(F.lit('{ "b": "x  y", "a": "'), i, F.lit('" }')))
    return P.strict_json(_read(spark, sf, "events").select("event_id", text.alias("payload")), "payload", "a string, b string", ["a"]).select("event_id", "fault")


@query("""select o_orderkey, case when o_orderkey % 12 = 0 then 'BATCH_MISMATCH' when o_orderkey % 18 = 0 then 'HASH_MISMATCH' end as fault from orders""")
def identity_bridge(spark, sf):
    k = F.col("o_orderkey")
    o = _read(spark, sf, "orders").select("o_orderkey", F.lit("b").alias("b1"), F.when(k % 12 == 0, "x").otherwise("b").alias("b2"), F.lit("h").alias("h1"), F.when(k % 18 == 0, F.lit(None)).otherwise("h").alias("h2"))
    return P.identity_faults(o, [("b1", "b2", "BATCH_MISMATCH"), ("h1", "h2", "HASH_MISMATCH")]).select("o_orderkey", "fault")


@query("""select job_id as document_id, arg_max(s, seq) as last_status, bool_or(s = 'REVIEW_REQUIRED') as review, count(*) as attempts, case when arg_max(s, seq) = 'FAILED' then 'FAILED' when bool_or(s = 'REVIEW_REQUIRED') then 'REVIEW_REQUIRED' when arg_max(s, seq) = 'SKIPPED' then 'SKIPPED' else 'SUCCEEDED' end as status
  from (select *, case event_type when 'error' then 'FAILED' when 'signup' then 'SKIPPED' when 'click' then 'REVIEW_REQUIRED' else 'SUCCEEDED' end as s from jobs) j group by job_id""", "jobs")
def workflow_rollup(spark, sf):
    s = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "SKIPPED").when(F.col("event_type") == "click", "REVIEW_REQUIRED").otherwise("SUCCEEDED")
    j = derived(spark, sf, "jobs").select(F.col("job_id").alias("document_id"), F.col("seq").alias("position"), s.alias("status"), F.lit(1).alias("attempt"), F.col("ts").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("ended"))
    return P.workflow_status(j).select("document_id", "last_status", "review", "attempts", "status")


@query("select user_id as workflow_id, count(distinct event_type) as documents from events group by user_id having count(distinct event_type) > 1")
def foreign_results(spark, sf):
    return P.foreign_results(_read(spark, sf, "events").select(F.col("user_id").alias("workflow_id"), F.col("event_type").alias("document_id")))


@query("select document_id, case when document_id % 3 = 0 then 'b' else 'a' end as engine, document_id % 3 = 0 as review, case when document_id % 3 = 0 then 'PRIMARY_PROVIDER_FAILED' end as reason from inv", "inv")
def provider_fallback(spark, sf):
    i = derived(spark, sf, "inv").select("document_id", F.when(F.col("document_id") % 3 != 0, "a").alias("engine"))
    return P.with_fallback(i, i.select("document_id", F.lit("b").alias("engine")), ["document_id"], "engine")


@query("select document_id from inv where document_id % 25 = 0", "inv")
def tamper_audit(spark, sf):
    r = P.memory_records(derived(spark, sf, "inv").select("tenant_id", "document_id", "currency", "subtotal"), finance.NAMESPACE)
    touched = r.withColumn("currency", F.when(F.col("document_id") % 25 == 0, "ZZZ").otherwise(F.col("currency")))
    return P.tampered(touched, ["tenant_id", "document_id", "currency", "subtotal"]).select("document_id")


@query("""select o_orderkey, concat_ws('|', case when o_orderkey % 9 = 0 then 'STATUS_FLAG' end, case when o_orderkey % 2 = 0 and o_orderkey % 5 = 0 then 'ACTIVE_CASE' end, case when o_orderkey % 2 = 1 and o_orderkey % 7 = 0 then 'UNEXPECTED_CASE' end) as faults from orders""")
def invariant_audit(spark, sf):
    k = F.col("o_orderkey")
    review = k % 2 == 0
    cases = F.when(review, F.when(k % 5 == 0, 2).otherwise(1)).otherwise(F.when(k % 7 == 0, 1).otherwise(0))
    rows = _read(spark, sf, "orders").select("o_orderkey", F.when(review != (k % 9 == 0), "REVIEW_REQUIRED").otherwise("SUCCEEDED").alias("status"), review.alias("review"), cases.alias("active_cases"), F.lit(0).alias("unassigned"), F.array(F.lit("r")).alias("case_reasons"), F.array(F.lit("r")).alias("record_reasons"))
    return P.invariant_faults(rows).select("o_orderkey", F.array_join("faults", "|").alias("faults"))


@query("select document_id, case when document_id % 4 = 1 then 111 when document_id % 4 = 2 then 11 when document_id % 4 = 3 then 1 else 0 end as passed from inv", "inv")
def incremental_rerun(spark, sf):
    stored = derived(spark, sf, "inv").select("document_id", F.lit(0).alias("passed"))
    k = F.col("document_id") % 4
    plans = stored.filter(k != 0).select("document_id", F.when(k == 1, "FINANCIAL_VALIDATION").when(k == 2, "REFERENCE_MATCHING").otherwise("MEMORY_PERSISTENCE").alias("restart"))
    add = lambda n: lambda df: df.withColumn("passed", F.col("passed") + n)
    stages = {"FINANCIAL_VALIDATION": add(100), "REFERENCE_MATCHING": add(10), "MEMORY_PERSISTENCE": add(1)}
    return P.rerun(stored, plans, list(stages), stages)


@query("""select o_orderkey, concat_ws('|', case when o_orderstatus <> 'F' then 'RESOLVED_CASE_REQUIRED' end, case when o_orderkey % 6 = 0 then 'CASE_ASSIGNED_TO_DIFFERENT_REVIEWER' end, case when o_orderkey % 8 = 0 then 'STALE_REVIEW_REVISION' end, case when o_orderkey % 5 = 0 then 'RESUME_DISPOSITION_INVALID' end,
  case when o_orderkey % 5 = 0 or o_orderkey % 11 = 0 then 'DECISION_DISPOSITION_MISMATCH' end) as errors from orders""")
def resume_validation(spark, sf):
    k = F.col("o_orderkey")
    r = _read(spark, sf, "orders").select("o_orderkey", F.lit("RESUME_WORKFLOW").alias("action"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("case_status"), F.lit("u").alias("actor"), F.when(k % 6 == 0, "v").otherwise("u").alias("assignee"), F.lit(1).alias("observed_revision"), F.when(k % 8 == 0, 2).otherwise(1).alias("revision"),
        F.when(k % 5 != 0, "APPROVED").alias("disposition"), F.when(k % 11 == 0, "CORRECTED").otherwise("APPROVED").alias("decision_disposition"), F.array().cast("array<string>").alias("corrections"), F.array(F.lit("r")).alias("reason_codes"))
    return P.resume_errors(r).select("o_orderkey", F.array_join("errors", "|").alias("errors"))


@query("""select user_id as case_id, arg_max(d, (ts, event_id)) as resolution, count(*) + 1 as revision, case when arg_max(d, (ts, event_id)) in ('APPROVED', 'CORRECTED', 'REJECTED') then 'RESOLVED' else 'CLAIMED' end as status from (select *, case event_type when 'view' then 'APPROVED' when 'click' then 'CORRECTED' when 'error' then 'REJECTED' else 'HOLD' end as d from events) e group by user_id""")
def decision_application(spark, sf):
    d = F.when(F.col("event_type") == "view", "APPROVED").when(F.col("event_type") == "click", "CORRECTED").when(F.col("event_type") == "error", "REJECTED").otherwise("HOLD")
    return P.case_state(_read(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_id"), d.alias("disposition")))


@query("select po_key as document_id, least(count(*), 500)::bigint as n from po_lines group by po_key", "po_lines")
def line_items(spark, sf):
    cells = _sql(spark, sf, "select po_key as document_id, 1 as page, line_number as row, 'DESCRIPTION' as col, 'x' as text, 90.0D as confidence from {po_lines} union all select po_key, 1, line_number, 'AMOUNT', '1', 90.0D from {po_lines} union all select po_key, 2, line_number, 'UNIT_PRICE', '1', 90.0D from {po_lines}", "po_lines")
    return X.line_items(cells).groupBy("document_id").agg(F.count("*").alias("n"))
