"""Queries on layout extraction, storage, review, routing and streams, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import layout as L
from tallybook.operators import review as R
from tallybook.operators import store as S
from tallybook.operators import workflow as W
from tallybook.plans import finance
from tallybook.sources.derived import derived, with_tables
from tallybook.sources.shared import fresh_folder
from tallybook.streaming import jobs as J

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return register


def _read(spark: SparkSession, sf: str, *names: str):
    out = [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]
    return out[0] if len(out) == 1 else out


def _sql(spark: SparkSession, sf: str, text: str, *names: str, **frames: DataFrame) -> DataFrame:
    """Shared SQL over tables and derived tables written as {name}."""
    from tallybook.sources.derived import TABLES

    return spark.sql(text, **{n: derived(spark, sf, n) if n in TABLES else _read(spark, sf, n) for n in names}, **frames)


# ---- layout -------------------------------------------------------------------------------

_LINES_SQL = """
  select document_id, 1 as page, n as line_order, text, x, y, w, 20 as h from (
    select document_id, 1 as n, concat('ACME ', coalesce(supplier_name, 'Stores')) as text, 50 as x, 40 as y, 200 as w from {invoices}
    union all select document_id, 2, 'Buyer Company', 500, 40, 200 from {invoices}
    union all select document_id, 3, concat('Invoice No: INV-', cast(document_id as string)), 50, 120, 250 from {invoices}
    union all select document_id, 4, 'Invoice Date', 50, 160, 120 from {invoices}
    union all select document_id, 5, cast(invoice_date as string), 200, 162, 100 from {invoices}
    union all select document_id, 6, 'Due Date', 450, 160, 100 from {invoices}
    union all select document_id, 7, '2030-01-15', 460, 200, 100 from {invoices}
    union all select document_id, 8, 'Subtotal', 400, 600, 80 from {invoices}
    union all select document_id, 9, concat('$', cast(coalesce(subtotal, 0) as string)), 600, 602, 100 from {invoices}
    union all select document_id, 10, 'TOTAL', 400, 660, 60 from {invoices}
    union all select document_id, 11, concat('$', cast(total as string)), 600, 662, 100 from {invoices} where total is not null) t""".replace("{invoices}", "invoices")


#: Invoices whose lines and words one task writes out and groups; Spark sizes tasks by the invoices, their words take 100 times as much.
INVOICES = 25_000


def dealt_invoices(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the invoices, dealt by document to tasks of INVOICES."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-_read(spark, sf, "orders").count() // INVOICES))
    tasks += tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))  # a dealing like the join's own would be left out
    return derived(spark, sf, "invoices").select(*columns).repartition(tasks, "document_id")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that _LINES_SQL describes, in one pass over the invoices, which are dealt to tasks first: grown rows are sorted within a
    task's memory and stay dealt by document."""
    text = lambda c: F.col(c).cast("string")
    money = lambda c: F.concat(F.lit("$"), c.cast("string"))
    layout = [
        (F.concat(F.lit("ACME "), F.coalesce("supplier_name", F.lit("Stores"))), 50, 40, 200), (F.lit("Buyer Company"), 500, 40, 200), (F.concat(F.lit("Invoice No: INV-"), text("document_id")), 50, 120, 250),
        (F.lit("Invoice Date"), 50, 160, 120), (text("invoice_date"), 200, 162, 100), (F.lit("Due Date"), 450, 160, 100), (F.lit("2030-01-15"), 460, 200, 100), (F.lit("Subtotal"), 400, 600, 80),
        (money(F.coalesce(F.col("subtotal"), F.lit(0).cast("decimal(18,2)"))), 600, 602, 100), (F.lit("TOTAL"), 400, 660, 60), (money(F.col("total")), 600, 662, 100),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("line_order"), t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w")) for n, (t, x, y, w) in enumerate(layout, 1)])
    dealt = dealt_invoices(spark, sf, "document_id", "supplier_name", "invoice_date", "subtotal", "total")
    out = dealt.select("document_id", F.lit(1).alias("page"), F.inline(rows)).filter("text is not null").withColumn("h", F.lit(20))
    return out.withColumn("right", F.col("x") + F.col("w")).withColumn("bottom", F.col("y") + F.col("h"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = _lines(spark, sf).select("document_id", "page", "line_order", "x", "y", "h", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    conf = (F.col("document_id") * 7 + F.col("line_order") * 13 + F.col("pos") * 5) % 101
    return words.select("document_id", "page", (F.col("line_order") * 100 + F.col("pos")).alias("reading_order"), "text", conf.cast("double").alias("confidence"), (F.col("x") + F.col("pos") * 50).alias("x"), "y", F.lit(45).alias("w"), "h", F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("line_order").alias("line"), F.col("pos").alias("word"))


_TOKENS_SQL = f"""select document_id, page, line_order, text, x, y, h, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from ({_LINES_SQL}) q"""


@query(f"""select document_id, line_order::integer as line_order, any_value(text) as text, round(avg((document_id * 7 + line_order * 13 + pos * 5) % 101), 2) as confidence, (max(x + pos * 50 + 45) - min(x))::bigint as width, count(*) as n_tokens from ({_TOKENS_SQL}) t group by document_id, line_order""", "invoices")
def token_lines(spark, sf):
    return L.lines_of(_tokens(spark, sf)).select("document_id", F.col("line").alias("line_order"), "text", "confidence", F.col("w").cast("long").alias("width"), "n_tokens")


@query(f"""select document_id, n_tokens, n_low, n_chars, concat_ws('|', case when n_tokens < 5 then 'TOO_FEW_TOKENS' end, case when n_chars < 20 then 'TOO_FEW_CHARACTERS' end, case when m < 70 then 'LOW_MEAN_CONFIDENCE' end, case when n_low / n_tokens > 0.35 then 'LOW_CONFIDENCE_RATIO' end) as reasons
  from (select document_id, count(*) as n_tokens, count(*) filter ((document_id * 7 + line_order * 13 + pos * 5) % 101 < 60) as n_low, sum(length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')))::bigint as n_chars, round(avg((document_id * 7 + line_order * 13 + pos * 5) % 101), 4) as m from ({_TOKENS_SQL}) t group by document_id) g""", "invoices")
def page_confidence(spark, sf):
    return L.page_confidence(_tokens(spark, sf)).select("document_id", "n_tokens", "n_low", "n_chars", F.array_join("reasons", "|").alias("reasons"))


@query("select document_id from invoices where total is null", "invoices")
def total_guard(spark, sf):
    return L.totals_without_value(_lines(spark, sf)).select("document_id")


@query(None)
def row_clusters(spark, sf):
    return L.row_clusters(_lines(spark, sf).withColumn("box_id", F.col("line_order").cast("long")))


_CANDIDATES = """select user_id as document_id, event_type as field, cast(event_id % 7 as string) as value, case event_id % 4 when 0 then 'LABEL_VALUE' when 1 then 'REGULAR_EXPRESSION' when 2 then 'SPATIAL_PROXIMITY' else 'COMBINED_RULES' end as method,
  event_id * 37 % 101 as confidence, event_id as seq from {events}"""


@query(f"""with c as ({_CANDIDATES.replace('{events}', 'events')}), o as (select *, case method when 'LABEL_VALUE' then 5 when 'REGULAR_EXPRESSION' then 3 when 'SPATIAL_PROXIMITY' then 2 else 1 end as p from c qualify row_number() over (partition by document_id, field, value order by confidence desc, seq) = 1),
  r as (select *, lead(p) over w as np, lead(confidence) over w as nc, row_number() over w as k from o window w as (partition by document_id, field order by p desc, confidence desc, seq))
  select document_id, field, value, method, confidence, coalesce(np = p and confidence - nc < 10, false) as ambiguous from r where k = 1""")
def best_candidate(spark, sf):
    return L.best_candidates(_sql(spark, sf, _CANDIDATES, "events")).select("document_id", "field", "value", "method", "confidence", "ambiguous")


@query(f"""with c as ({_CANDIDATES.replace('{events}', 'events')}) select document_id, 'REQUIRED_FIELD_MISSING:' || f as reason from (select distinct document_id from c) d, (select unnest(['signup', 'purchase', 'refund']) as f) x where not exists (select 1 from c where c.document_id = d.document_id and c.field = x.f)""")
def required_fields(spark, sf):
    c = _sql(spark, sf, _CANDIDATES, "events")
    return L.missing_fields(L.best_candidates(c), c.select("document_id").distinct(), ["signup", "purchase", "refund"])


_CELLS = "select po_key as document_id, 1 as page, line_number, part_key * 13 % 800 as x, case when part_key % 3 = 0 then 'Blue widget' else concat('SKU-', cast(part_key as string)) end as text from {po_lines}"
_HEADS = "select po_key as document_id, 1 as page, 'DESCRIPTION' as col, 100 + po_key % 10 as hx from {po} union all select po_key, 1, 'QUANTITY', 300 from {po} union all select po_key, 1, 'PRICE', 520 from {po} union all select po_key, 1, 'AMOUNT', 700 from {po}"


@query("select po_key as document_id, line_number, x, case when x < (100 + po_key % 10 + 300) / 2 then 'DESCRIPTION' when x < 410 then 'QUANTITY' when x < 610 then 'PRICE' else 'AMOUNT' end as col from (select *, part_key * 13 % 800 as x from po_lines) c where part_key % 3 = 0 or x >= 90 + po_key % 10", "po_lines")
def column_assignment(spark, sf):
    return L.assign_columns(_sql(spark, sf, _CELLS, "po_lines"), _sql(spark, sf, _HEADS, "po")).select("document_id", "line_number", "x", "col")


# ---- intake and storage -------------------------------------------------------------------


@query("select doc_id, sha256(text) as digest, row_number() over (partition by sha256(text) order by doc_id) > 1 as duplicate from documents")
def duplicate_documents(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    return S.first_seen(d, ["digest"], ["doc_id"])


@query("select p_partkey, case p_partkey % 7 when 0 then 'FILENAME_EXTENSION' when 1 then null when 2 then 'FILENAME_PATH_SEPARATOR' when 3 then 'FILENAME_TRAVERSAL' when 4 then 'FILENAME_EDGE_SPACE' when 5 then 'FILENAME_TOO_LONG' else 'FILENAME_CHARACTER' end as code from part")
def filename_validation(spark, sf):
    p = _read(spark, sf, "part")
    k, n = F.col("p_partkey") % 7, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(n, F.lit(".exe"))).when(k == 1, F.concat(F.lit("scan "), n, F.lit(".PDF"))).when(k == 2, F.concat(F.lit("a/"), n, F.lit(".pdf"))).when(k == 3, F.concat(n, F.lit("..pdf"))).when(k == 4, F.concat(F.lit(" "), n, F.lit(".pdf"))).when(k == 5, F.concat(F.repeat(F.lit("x"), 130), n)).otherwise(F.concat(n, F.lit("é.pdf")))
    return p.select("p_partkey", W.filename_code(name).alias("code"))


_PAGES = "select event_id, event_id % 900 + 300 as width, event_id % 1100 + 400 as height, event_id * 7 % 256 as brightness, event_id * 11 % 100 as contrast, event_id * 13 % 120 as blur, event_id % 41 - 20 as skew, event_id % 100 / 1000.0 as dark_ratio from {events}"


@query(f"""select event_id, concat_ws('|', case when width < 500 or height < 700 then 'LOW_RESOLUTION' end, case when brightness < 35 then 'TOO_DARK' end, case when brightness > 235 and dark_ratio < 0.005 then 'POSSIBLY_BLANK_OR_OVEREXPOSED' end, case when contrast < 20 then 'LOW_CONTRAST' end,
  case when blur < 45 then 'POSSIBLE_BLUR' end, case when abs(skew) > 15 then 'EXCESSIVE_SKEW' end) as flags from ({_PAGES.replace('{events}', 'events')}) p""")
def page_quality(spark, sf):
    return W.page_flags(_sql(spark, sf, _PAGES, "events")).select("event_id", F.array_join("flags", "|").alias("flags"))


_STORED = "select document_id, md5(concat(cast(document_id as string), cast(coalesce(total, 0) as string))) as digest, batch_id, tenant_id from {invoices} where document_id % 3 <> 0"
_INCOMING = "select document_id, md5(concat(cast(document_id as string), cast(coalesce(total, 0) as string), case when document_id % 5 = 0 then 'x' else '' end)) as digest, case when document_id % 8 = 0 then 'BATCH-X' else batch_id end as batch_id, case when document_id % 77 = 0 then 'TEN-X' else tenant_id end as tenant_id from {invoices} where document_id % 4 <> 0"


@query("select document_id, case when document_id % 3 = 0 then 'NEW' when document_id % 5 = 0 then 'COLLISION' else 'SAME' end as outcome from invoices where document_id % 4 <> 0", "invoices")
def insert_if_absent(spark, sf):
    return S.insert_if_absent(_sql(spark, sf, _STORED, "invoices"), _sql(spark, sf, _INCOMING, "invoices"), "document_id", "digest")


@query("""select document_id, case when document_id % 3 = 0 then 'EXTRA' when document_id % 4 = 0 then 'MISSING' else 'HASH_DISCONTINUITY' end as anomaly from invoices
  where (document_id % 3 = 0) <> (document_id % 4 = 0) or (document_id % 3 <> 0 and document_id % 4 <> 0 and document_id % 5 = 0)""", "invoices")
def phase_alignment(spark, sf):
    return S.align(_sql(spark, sf, _STORED, "invoices"), _sql(spark, sf, _INCOMING, "invoices"), "document_id", "batch_id", "digest")


@query("select document_id, tenant_id, 'TEN-X' as other_tenant from invoices where document_id % 77 = 0 and document_id % 3 <> 0 and document_id % 4 <> 0", "invoices")
def tenant_leak_audit(spark, sf):
    return S.tenant_leaks(_sql(spark, sf, _STORED, "invoices"), _sql(spark, sf, _INCOMING, "invoices"), "document_id")


@query("select document_id, batch_id, total::double as total from invoices where tenant_id = 'TEN-1'", "invoices")
def tenant_view(spark, sf):
    return S.for_tenant(derived(spark, sf, "invoices"), "TEN-1").select("document_id", "batch_id", F.col("total").cast("double").alias("total"))


_VERSIONS = "select l_orderkey as document_id, l_linenumber as version, l_shipdate as created_at, l_extendedprice as total, l_returnflag as state from {lineitem}"


@query("select o_orderkey as document_id, coalesce(t, o_totalprice) as total, coalesce(s, o_orderstatus) as state, t is not null as revised from orders left join (select l_orderkey, max(l_extendedprice) as t, min(l_returnflag) as s from (select *, rank() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_extendedprice desc, l_returnflag) as r from lineitem) x where r = 1 group by l_orderkey) v on l_orderkey = o_orderkey")
def effective_memory(spark, sf):
    versions = S.latest(_sql(spark, sf, _VERSIONS, "lineitem"), ["document_id"], [F.desc("created_at"), F.desc("version"), F.desc("total"), "state"])
    original = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("state"))
    return S.effective(original, versions, "document_id", ["total", "state"])


@query("""select o_orderkey, 'STATUS' as rule from orders where o_orderstatus not in ('F', 'O') union all select o_orderkey, 'PRICE' from orders where not coalesce(o_totalprice > 1000, false)
  union all select o_orderkey, 'URGENT_IS_OPEN' from orders where o_orderpriority like '1%' and o_orderstatus = 'F'""")
def constraint_audit(spark, sf):
    rules = {"STATUS": F.col("o_orderstatus").isin("F", "O"), "PRICE": F.col("o_totalprice") > 1000, "URGENT_IS_OPEN": ~F.col("o_orderpriority").startswith("1") | (F.col("o_orderstatus") != "F")}
    return S.violations(_read(spark, sf, "orders"), ["o_orderkey"], rules)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def unique_audit(spark, sf):
    return S.not_unique(_read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def fk_audit(spark, sf):
    parent = _read(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return S.orphans(_read(spark, sf, "lineitem"), parent, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'DELETED' else 'CHANGED:o_orderstatus' end as change from orders where o_orderkey % 10 = 0 or (o_orderkey % 13 = 0 and o_orderstatus <> 'O')")
def snapshot_audit(spark, sf):
    before = _read(spark, sf, "orders")
    after = before.filter("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "O").otherwise(F.col("o_orderstatus")))
    return S.snapshot_changes(before.select("o_orderkey", "o_orderstatus", "o_custkey"), after.select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("select source, count(*) as artifacts, sum(strlen(text))::bigint as bytes, sha256(string_agg(sha256(text), '|' order by sha256(text))) as digest from documents group by source")
def artifact_manifest(spark, sf):
    return S.manifest(_read(spark, sf, "documents").filter("text is not null"), "source", "text")


@query("select source, case when hit then 'SIZE' else 'DIGEST' end as fault from (select source, bool_or(doc_id % 100 = 0) as hit, bool_or(doc_id % 101 = 0) as other from documents group by source) d where hit")
def manifest_verification(spark, sf):
    d = _read(spark, sf, "documents").filter("text is not null")
    altered = d.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return S.verify_manifest(S.manifest(d, "source", "text"), S.manifest(altered, "source", "text"), "source")


@query("select event_id, seq, status from jobs where job_id = 7 and seq > 3 order by seq limit 500", "jobs")
def event_tail(spark, sf):
    return derived(spark, sf, "jobs").filter("job_id = 7 and seq > 3").orderBy("seq").limit(500).select("event_id", "seq", "status")


# ---- review -------------------------------------------------------------------------------

_CASES = """select o_orderkey as case_id, concat('TEN-', cast(o_orderkey % 4 as string)) as tenant_id, case o_orderstatus when 'O' then 'OPEN' when 'F' then 'CLAIMED' else 'RESOLVED' end as status, cast(substring(o_orderpriority, 1, 1) as int) as priority,
  case when o_orderkey % 3 = 0 or o_orderstatus = 'O' then null else concat('USER-', cast(o_orderkey % 5 as string)) end as assignee, o_orderdate as opened_at from {orders}"""
_CASES_SQL = _CASES.replace("{orders}", "orders")


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _CASES, "orders")


@query(f"with c as ({_CASES_SQL}) select tenant_id, count(*) as total, count(*) filter (status in ('OPEN', 'CLAIMED')) as active, count(*) filter (status in ('OPEN', 'CLAIMED') and assignee is null) as unassigned, count(*) filter (priority <= 2) as urgent from c group by tenant_id")
def dashboard(spark, sf):
    return R.dashboard(_cases(spark, sf))


@query(f"with c as ({_CASES_SQL}) select case_id, priority, assignee from c where status in ('OPEN', 'CLAIMED') and tenant_id = 'TEN-2' order by priority, opened_at, case_id limit 50 offset 50")
def review_queue(spark, sf):
    return R.queue_page(_cases(spark, sf), page=2, size=50, tenant_id="TEN-2", assignee=None).select("case_id", "priority", "assignee")


@query("select event_type as reason, count(*) as n from events group by event_type")
def reason_histogram(spark, sf):
    by_user = _read(spark, sf, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("reasons"))
    return R.reason_histogram(by_user)


@query("select job_id, seq as last_seq, status from jobs qualify row_number() over (partition by job_id order by seq desc) = 1", "jobs")
def latest_decision(spark, sf):
    return S.latest(derived(spark, sf, "jobs"), ["job_id"], [F.desc("seq")]).select("job_id", F.col("seq").alias("last_seq"), "status")


@query("select o_orderkey as decision_id from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def resume_requested(spark, sf):
    audit = _read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.to_json(F.struct(F.col("l_orderkey").alias("decision_id"))).alias("payload"))
    decisions = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("decision_id"))
    return decisions.join(audit, F.get_json_object("payload", "$.decision_id") == F.col("decision_id").cast("string"), "left_semi")


_ACTIONS_SQL = "['" + "','".join(R.ACTIONS) + "']"


@query("""select case_id, concat_ws('|', case when o % 11 = 0 then 'CROSS_TENANT_COMMAND' end, case when o % 7 = 0 then 'IDEMPOTENCY_KEY_INVALID' end, case when o % 2 = 0 and act in ('ACCEPT', 'REJECT') then 'ACTION_NOT_PERMITTED' end, case when o % 13 = 0 then 'STALE_REVIEW_REVISION' end,
  case when act = 'CLAIM' and st <> 'OPEN' then 'CASE_NOT_OPEN' end, case when act <> 'CLAIM' and st <> 'IN_REVIEW' then 'CASE_NOT_CLAIMED' end, case when act <> 'CLAIM' and o % 17 = 0 then 'CASE_ASSIGNED_TO_DIFFERENT_REVIEWER' end, case when act in ('ACCEPT', 'REJECT') and o % 5 = 0 then 'DISPOSITION_REQUIRED' end,
  case when act = 'REJECT' and o % 5 <> 0 then 'DISPOSITION_MISMATCH' end, case when act = 'CLAIM' and o % 5 <> 0 then 'DISPOSITION_NOT_ALLOWED' end, case when act <> 'CLAIM' and o % 3 = 0 then 'REASON_CODE_REQUIRED' end, case when act = 'REJECT' then 'NOTES_REQUIRED' end) as errors
  from (select o_orderkey as case_id, o_orderkey as o, case (o_orderkey // 2) % 3 when 0 then 'CLAIM' when 1 then 'ACCEPT' else 'REJECT' end as act, case o_orderstatus when 'O' then 'OPEN' else 'IN_REVIEW' end as st from orders) c""")
def command_validation(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    act = F.expr("case (o_orderkey div 2) % 3 when 0 then 'CLAIM' when 1 then 'ACCEPT' else 'REJECT' end")
    actor = F.lit("USER-1")
    c = o.select(
        k.alias("case_id"), act.alias("action"), actor.alias("actor"), F.lit("2024-01-01").alias("authenticated_at"), F.lit("2024-01-02").alias("requested_at"), F.lit("T").alias("tenant_id"), F.when(k % 11 == 0, "U").otherwise("T").alias("case_tenant_id"),
        F.when(k % 7 == 0, "short").otherwise(F.concat(F.lit("command-key-"), k.cast("string"))).alias("idempotency_key"), F.when(k % 2 == 0, "AP_OPERATOR").otherwise("AP_REVIEWER").alias("role"), F.lit(1).alias("observed_revision"), F.when(k % 13 == 0, 2).otherwise(1).alias("revision"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("IN_REVIEW").alias("case_status"), F.when(act == "CLAIM", F.lit(None)).when(k % 17 == 0, "USER-2").otherwise(actor).alias("assignee"), F.when(k % 5 != 0, "APPROVED").alias("disposition"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("OK"))).alias("reason_codes"), F.lit(" ").alias("notes"), F.array().cast("array<string>").alias("corrections"))
    return R.command_errors(c).select("case_id", F.array_join("errors", "|").alias("errors"))


@query("""select event_id as command_id, case when row_number() over w = 1 then 'FIRST' when value = first_value(value) over w then 'IDEMPOTENT' else 'CONFLICT' end as outcome from events window w as (partition by user_id, event_type order by ts, event_id)""")
def idempotency(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_id").alias("command_id"), F.col("user_id").alias("tenant_id"), F.col("event_type").alias("idempotency_key"), F.col("ts").alias("requested_at"), F.col("value").alias("fingerprint"))
    return R.idempotency(e)


@query(f"""with c as ({_CASES_SQL}) select case_id, 'USER-' || u as actor, case when status = 'OPEN' and assignee is null then case when u <> 4 then 'CLAIM' else '' end when status = 'CLAIMED' and assignee = 'USER-' || u and u <> 4 then case when u = 1 then 'RELEASE|CORRECT|CONFIRM_SUPPLIER|CONFIRM_PURCHASE_ORDER|REQUEST_INFORMATION|ESCALATE'
  else 'RELEASE|ACCEPT|CORRECT|CONFIRM_SUPPLIER|CONFIRM_PURCHASE_ORDER|REQUEST_INFORMATION|ESCALATE|REJECT' end else '' end as actions from c join (select unnest([1, 2, 3, 4]) as u) s on tenant_id = 'TEN-' || (u % 4)""")
def capabilities(spark, sf):
    staff = spark.createDataFrame([("USER-1", "AP_OPERATOR", "TEN-1"), ("USER-2", "AP_REVIEWER", "TEN-2"), ("USER-3", "TENANT_ADMIN", "TEN-3"), ("USER-4", "READ_ONLY_AUDITOR", "TEN-0")], "actor string, role string, tenant_id string")
    return R.capabilities(_cases(spark, sf), F.broadcast(staff)).select("case_id", "actor", F.array_join("actions", "|").alias("actions"))


_FIELDS = "select document_id, 'CURRENCY' as field_name, currency as value from {invoices} union all select document_id, 'SUPPLIER_NAME', supplier_name from {invoices}"
_FIXES = "select document_id, 'CURRENCY' as field_name, case when document_id % 6 = 0 then 'XXX' else currency end as previous, case when document_id % 4 = 0 then ' ' else 'EUR' end as corrected from {invoices} where document_id % 2 = 0 union all select document_id, 'PAYMENT_TERMS', null, 'NET 30' from {invoices} where document_id % 9 = 0"


@query("""select document_id, 'CURRENCY' as field_name, case when document_id % 2 = 0 and not (document_id % 6 = 0) and document_id % 4 <> 0 then 'EUR' else currency end as value, document_id % 2 = 0 and not (document_id % 6 = 0) and document_id % 4 <> 0 as corrected,
   case when document_id % 2 = 0 and document_id % 6 = 0 then 'PREVIOUS_VALUE_MISMATCH' when document_id % 2 = 0 and document_id % 4 = 0 then 'CORRECTED_VALUE_BLANK' end as error from invoices
  union all select document_id, 'SUPPLIER_NAME', supplier_name, false, null from invoices union all select document_id, 'PAYMENT_TERMS', 'NET 30', true, null from invoices where document_id % 9 = 0""", "invoices")
def correction_overlay(spark, sf):
    return R.overlay(_sql(spark, sf, _FIELDS, "invoices"), _sql(spark, sf, _FIXES, "invoices"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'MEMORY_PERSISTENCE' when 1 then 'FINANCIAL_VALIDATION' when 2 then 'REFERENCE_MATCHING' when 3 then 'FINANCIAL_VALIDATION' end as stage from orders""")
def restart_stage(spark, sf):
    k = F.col("o_orderkey") % 5
    f = F.when(k == 1, F.array(F.lit("SUPPLIER_NAME"), F.lit("TAX_AMOUNT"))).when(k == 2, F.array(F.lit("PURCHASE_ORDER_NUMBER"))).when(k == 3, F.array(F.lit("CUSTOMER_NAME"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, sf, "orders").select("o_orderkey", R.restart_stage(F.when(k == 0, "APPROVED").otherwise("CORRECTED"), f).alias("stage"))


@query(f"""{finance._REASONS} select document_id, 'OPEN' as status, 3 as priority, case when reasons = '' then 'INHERITED_REVIEW_REQUIRED' else reasons end as reasons from rs join fin using (document_id) where (failed + review > 0 or inherited_review) and document_id % 5 <> 0""", *finance._FIVE)
def new_review_cases(spark, sf):
    results = finance.match_all(spark, sf)
    existing = results.filter("document_id % 5 = 0").select("document_id")
    return R.open_cases(results, existing).select("document_id", "status", "priority", F.array_join("reasons", "|").alias("reasons"))


# ---- routing ------------------------------------------------------------------------------


@query("""select event_id, case when error_name = 'ArtifactHashMismatchError' then 'INTEGRITY' when error_name = 'ApprovalPolicyError' then 'POLICY' when message in ('relation does not exist', 'invalid hash for artifact') then 'PERMANENT' when error_name = 'ValueError' then 'PERMANENT'
  when error_name = 'OperationalError' or message like 'connection reset%' or message like '%too many requests%' or message like '%timeout%' then 'TRANSIENT' else 'UNKNOWN' end as failure from jobs""", "jobs")
def fn_failure_class(spark, sf):
    return derived(spark, sf, "jobs").select("event_id", W.failure_class(F.col("error_name"), F.col("message")).alias("failure"))


_STAGE_LIST = ", ".join(f"'{s}'" for s in W.STAGES)
_RESULTS = f"""select event_id, job_id, seq, element_at(array({_STAGE_LIST}), cast(seq % 7 + 1 as int)) as stage, case event_type when 'error' then 'FAILED' when 'signup' then 'SKIPPED' when 'click' then 'UNKNOWN' else 'SUCCEEDED' end as status,
  cast(event_id % 4 as int) as attempt, case when event_id % 2 = 0 then 'TRANSIENT' else 'PERMANENT' end as failure, event_id % 3 = 0 as review from {{jobs}}"""


@query(f"""with r as (select event_id, [{_STAGE_LIST}][seq % 7 + 1] as stage, [{_STAGE_LIST}][seq % 7 + 2] as following, event_type, event_id % 4 as attempt, event_id % 2 = 0 as transient, event_id % 3 = 0 as review from jobs),
  q as (select *, case when event_type = 'signup' then 'SKIP_IDEMPOTENT' when event_type = 'error' and transient and attempt < 3 then 'RETRY' when event_type in ('error', 'click') then 'STOP_FAILED' when stage = 'MEMORY_PERSISTENCE' then case when review then 'ROUTE_TO_REVIEW' else 'COMPLETE' end else 'CONTINUE' end as route from r)
  select event_id, route, case route when 'RETRY' then stage when 'ROUTE_TO_REVIEW' then 'HUMAN_REVIEW' when 'COMPLETE' then 'COMPLETED' when 'CONTINUE' then following end as next_stage, case when route = 'RETRY' and attempt + 1 > 1 then least(pow(2.0, attempt - 1), 8.0) else 0.0 end as delay from q""", "jobs")
def stage_routes(spark, sf):
    return W.route(_sql(spark, sf, _RESULTS, "jobs")).select("event_id", "route", "next_stage", "delay")


@query(f"""with r as (select event_id, job_id, seq, event_id % 7 as i from jobs), p as (select *, lag(i) over (partition by job_id order by seq) as b from r)
  select event_id, [{_STAGE_LIST}][b + 1] as before, [{_STAGE_LIST}][i + 1] as stage from p where b is not null and i <> b and i <> b + 1""", "jobs")
def illegal_transitions(spark, sf):
    rows = _sql(spark, sf, f"select event_id, job_id, seq, element_at(array({_STAGE_LIST}), cast(event_id % 7 + 1 as int)) as stage from {{jobs}}", "jobs")
    return W.illegal_transitions(rows, "job_id", ["seq"]).select("event_id", "before", "stage")


@query("""with p as (select event_id, status, lag(status) over (partition by job_id order by seq) as before from jobs)
  select event_id, before, status from p where before is not null and before || '>' || status not in ('QUEUED>RUNNING', 'RUNNING>RUNNING', 'RUNNING>SUCCEEDED', 'RUNNING>FAILED', 'QUEUED>FAILED')""", "jobs")
def job_lifecycle_audit(spark, sf):
    return W.illegal_job_moves(derived(spark, sf, "jobs")).select("event_id", "before", "status")


@query("select event_id, seq + case when seq > 5 then 1 else 0 end as seq, seq as expected from jobs where seq > 5", "jobs")
def sequence_audit(spark, sf):
    rows = derived(spark, sf, "jobs").withColumn("seq", F.col("seq") + F.when(F.col("seq") > 5, 1).otherwise(0))
    return W.sequence_faults(rows, "job_id", "seq").select("event_id", "seq", "expected")


_OUTCOMES = "select batch_id, case when document_id % 20 = 3 or document_id % 97 = 0 then 'FAILED' when document_id % 20 in (5, 6) then 'SUCCEEDED' when inherited_review then 'REVIEW_REQUIRED' when document_id % 50 = 7 then 'SKIPPED' else 'SUCCEEDED' end as outcome from {inv}"


@query(f"""select batch_id, count(*) as n, count(*) filter (outcome = 'SUCCEEDED') as succeeded, count(*) filter (outcome = 'REVIEW_REQUIRED') as review, count(*) filter (outcome = 'FAILED') as failed, count(*) filter (outcome = 'SKIPPED') as skipped,
  case when count(*) filter (outcome = 'FAILED') = count(*) then 'FAILED' when count(*) filter (outcome = 'FAILED') > 0 then 'PARTIALLY_FAILED' when count(*) filter (outcome = 'REVIEW_REQUIRED') > 0 then 'COMPLETED_WITH_REVIEW' else 'SUCCEEDED' end as status from ({_OUTCOMES.replace('{inv}', 'inv')}) o group by batch_id""", "inv")
def batch_rollup(spark, sf):
    return W.batch_rollup(_sql(spark, sf, _OUTCOMES, "inv"))


# ---- streams (run to the end of the given table) --------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return fresh_folder(spark, "stream")


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    at = _scratch(spark)
    J.drain(stream, f"{at}/rows", f"{at}/checkpoint", mode)
    return spark.read.parquet(f"{at}/rows")


@query("select user_id, event_type, 1::bigint as kept, 1::bigint as known from events group by user_id, event_type")
def stream_dedupe(spark, sf):
    """What the stream let through: one row of each key, and how many of those the events hold."""
    stream = J.stream_of(spark, f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    kept = _drained(spark, J.deduplicated(stream, ["user_id", "event_type"], "ts", "36500 days"))
    held = _read(spark, sf, "events").select("event_id", F.col("user_id").alias("_u"), F.col("event_type").alias("_t"))
    j = kept.join(held, "event_id", "left")
    return j.groupBy("user_id", "event_type").agg(F.count("*").alias("kept"), F.count_if((F.col("user_id") == F.col("_u")) & (F.col("event_type") == F.col("_t"))).alias("known"))


@query("""select job_id, f.s as status, n as events, f.n as illegal from (select job_id, count(*) as n, list_reduce(list_prepend({'s': '', 'n': 0::bigint}, list({'s': status, 'n': 0::bigint} order by seq)),
  lambda a, b: case when (a.s = '' and b.s = 'QUEUED') or (a.s = 'QUEUED' and b.s in ('RUNNING', 'FAILED')) or (a.s = 'RUNNING' and b.s in ('RUNNING', 'SUCCEEDED', 'FAILED')) then {'s': b.s, 'n': a.n} else {'s': a.s, 'n': a.n + 1} end) as f from jobs group by job_id) t""", "jobs")
def stream_job_state(spark, sf):
    """Events in order through the stateful fold; the last state of each job."""
    at = _scratch(spark)
    derived(spark, sf, "jobs").select("job_id", "seq", "status").repartition("job_id").sortWithinPartitions("job_id", "seq").write.parquet(f"{at}/events")
    return J.last_states(_drained(spark, J.job_states(J.stream_of(spark, f"{at}/events", 1)), "update"))


@query("select event_type, count(*) as n from events group by event_type")
def stream_reason_counts(spark, sf):
    out = _drained(spark, J.counts(J.stream_of(spark, f"{sf}/events.parquet"), "event_type"), "complete")
    return out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


_SUNK = "select event_id, user_id, case when event_id % 7 = 0 then 'other' else cast(user_id as string) end as digest, event_id < 5000 as early from {events}"


@query("""with e as (""" + _SUNK.replace("{events}", "events") + """), o as (select *, first_value(digest) over (partition by user_id order by early desc, event_id) as held, row_number() over (partition by user_id order by early desc, event_id) as k from e)
  select event_id, user_id, case when k = 1 then 'NEW' when digest = held then 'SAME' else 'COLLISION' end as outcome from o""")
def stream_sink(spark, sf):
    """Keyed rows in two batches through the inserting sink: the outcome of each."""
    at = _scratch(spark)
    rows = _sql(spark, sf, _SUNK, "events")
    for batch, part in enumerate((F.col("early"), ~F.col("early"))):
        rows.filter(part).drop("early").coalesce(1).write.mode("append").parquet(f"{at}/in/part={batch}")
        stream = spark.readStream.schema("event_id long, user_id long, digest string").option("recursiveFileLookup", "true").parquet(f"{at}/in")
        J.insert_stream(stream, f"{at}/out", f"{at}/checkpoint", "user_id", "digest", "event_id", buckets=16)
    return spark.read.parquet(f"{at}/out/outcomes").drop("batch")


@query("""with e as (""" + _SUNK.replace("{events}", "events") + """) select user_id, digest, event_id from e qualify row_number() over (partition by user_id order by early desc, event_id) = 1""")
def stream_sink_rows(spark, sf):
    """What that sink holds: each key's first row."""
    at = _scratch(spark)
    rows = _sql(spark, sf, _SUNK, "events")
    for batch, part in enumerate((F.col("early"), ~F.col("early"))):
        rows.filter(part).drop("early").coalesce(1).write.mode("append").parquet(f"{at}/in/part={batch}")
        stream = spark.readStream.schema("event_id long, user_id long, digest string").option("recursiveFileLookup", "true").parquet(f"{at}/in")
        J.insert_stream(stream, f"{at}/out", f"{at}/checkpoint", "user_id", "digest", "event_id", buckets=16)
    return spark.read.parquet(f"{at}/out/rows").select("user_id", "digest", "event_id")


@query("select doc_id, sha256(text) as sha256, exists (select 1 from documents k where k.doc_id % 3 = 0 and k.text = d.text) as duplicate from documents d")
def stream_known(spark, sf):
    """Documents as a stream, each flagged where its content is among the known ones."""
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")
    known = _read(spark, sf, "documents").filter("doc_id % 3 = 0").select(digest)
    stream = J.stream_of(spark, f"{sf}/documents.parquet").select("doc_id", digest)
    return _drained(spark, J.flagged_known(stream, known, "sha256")).select("doc_id", "sha256", "duplicate")


_CLAIMS = "select user_id as case_id, case when event_type in ('view', 'click') then 'CLAIMED' else 'RELEASED' end as status, date_trunc('second', ts) as seen_at, event_id from {events}"


@query("""with e as (""" + _CLAIMS.replace("{events}", "events") + """), o as (select *, lead(seen_at) over (partition by case_id order by seen_at, event_id) as next_at, max(seen_at) over () as latest from e)
  select case_id, seen_at as claimed_at, seen_at + interval 1800 second as expired_at from o where status = 'CLAIMED' and (next_at > seen_at + interval 1800 second or next_at is null and seen_at + interval 1800 second <= latest)""")
def stream_claim_timeouts(spark, sf):
    """Claims that time out, by timers of the stream; events of the same second count in the order of their ids."""
    at = _scratch(spark)
    _sql(spark, sf, _CLAIMS, "events").repartition("case_id").write.parquet(f"{at}/events")  # whole cases in a file, all files in one batch
    events = J.stream_of(spark, f"{at}/events", 1_000_000).select("case_id", "status", F.col("seen_at").cast("timestamp").alias("at"), "event_id")
    return _drained(spark, J.claim_timeouts(events, order="event_id")).select("case_id", "claimed_at", "expired_at")
