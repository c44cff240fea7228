"""Queries on functions, validation and matching, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import text as T
from tallybook.functions import values as V
from tallybook.operators import matching as M
from tallybook.operators import validation as C
from tallybook.sources.derived import derived, held_tables, with_tables
from tallybook.sources.shared import fresh_folder, spread

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The SQL of each query as written, before the definitions of derived tables.
RAW: dict[str, str | None] = {}


def query(sql: str | None = None, *tables: str):
    def register(f):
        QUERIES[f.__name__] = f
        RAW[f.__name__] = sql
        if sql:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return register


def _inv(spark: SparkSession, sf: str, get=None) -> DataFrame:
    """Invoices as the checks read them."""
    i = get("invoices") if get else derived(spark, sf, "invoices")
    bad, due = F.col("invoice_date_bad"), F.col("due_present")
    days = F.when(F.col("due_early"), F.lit(-5)).otherwise(F.lit(30))
    signal = F.array_compact(F.array(F.upper("currency"), F.when(F.col("symbol") == "$", "USD")))
    return i.withColumn("due_date", F.when(due, F.date_add("invoice_date", days))).withColumn("due_date_present", due).withColumn("invoice_date_present", F.lit(True)).withColumn("invoice_date", F.when(~bad, F.col("invoice_date"))).withColumn("signals", signal)


def _checks(df: DataFrame) -> DataFrame:
    """Flat columns, for comparison by value."""
    return df.select("document_id", "scope", "status", F.col("expected").cast("double").alias("expected"), F.col("observed").cast("double").alias("observed"), F.array_join("reasons", "|").alias("reasons"))


# ---- functions ---------------------------------------------------------------------------

_DOC = "documents"
_WS = "[ \\t\\n\\x0b\\f\\r]+"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("select doc_id, md5(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[^A-Z0-9]', '', 'g')) as key_md5 from documents")
def fn_comparison_key(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.encode(T.comparison_key(F.col("text")), "UTF-8")).alias("key_md5"))


@query("select s_suppkey, upper(trim(regexp_replace(s_name || ', & Co. ' || n_name, '[^A-Za-z0-9]+', ' ', 'g'))) as key from supplier join nation on n_nationkey = s_nationkey")
def fn_business_key(spark, sf):
    s, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("supplier", "nation"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", T.business_key(F.concat("s_name", F.lit(", & Co. "), "n_name")).alias("key"))


@query("select document_id, upper(regexp_replace(regexp_replace(po_reference, '^(PO No\\.: |PO-)', ''), '[^A-Za-z0-9]', '', 'g')) as key from invoices where po_reference is not null", "invoices")
def fn_reference_key(spark, sf):
    return derived(spark, sf, "invoices").filter("po_reference is not null").select("document_id", T.reference_key(F.col("po_reference")).alias("key"))


_MONEY_TEXT = """
  select document_id, document_id % 6 as form, total,
    case when total is null then 'n/a' else case document_id % 6
      when 0 then concat('Total: $', cast(total as string)) when 1 then concat('(', cast(total as string), ')') when 2 then concat('TAX 8.5% ', cast(total as string), ' USD')
      when 3 then concat('EUR ', replace(cast(total as string), '.', ',')) when 4 then concat('- $', cast(total as string)) else concat('1,', lpad(cast(cast(floor(abs(total)) as bigint) % 1000 as string), 3, '0'), '.50 RMB') end end as raw
  from invoices"""
_GROUPED = "1000.5 + cast(floor(abs(total)) as bigint) % 1000"


def _money_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_MONEY_TEXT.replace("from invoices", "from {invoices}"), invoices=derived(spark, sf, "invoices"))


@query(f"select document_id, cast(case when total is null then null when form in (1, 4) then -abs(total) when form = 5 then {_GROUPED} else total end as double) as amount from ({_MONEY_TEXT}) m", "invoices")
def fn_money(spark, sf):
    return _money_text(spark, sf).select("document_id", V.money(F.col("raw")).cast("double").alias("amount"))


@query(f"select document_id, cast(case when total is null then null when form = 1 then -abs(total) when form = 2 then 8.5 when form = 5 then {_GROUPED} else total end as double) as amount from ({_MONEY_TEXT}) m", "invoices")
def fn_decimal(spark, sf):
    return _money_text(spark, sf).select("document_id", V.parse_decimal(F.col("raw")).cast("double").alias("amount"))


@query(f"select document_id, case when total is null then null else case form when 0 then 'USD' when 2 then 'USD' when 3 then 'EUR' when 4 then 'USD' when 5 then 'CNY' end end as code from ({_MONEY_TEXT}) m", "invoices")
def fn_currency(spark, sf):
    return _money_text(spark, sf).select("document_id", V.currency_code(F.col("raw")).alias("code"))


@query("""select o_orderkey, case o_orderkey % 4 when 2 then case when day(o_orderdate) > 12 then cast(o_orderdate as date) end else cast(o_orderdate as date) end::varchar as parsed from orders""")
def fn_date(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("Invoice Date: "), F.date_format(d, "yyyy-MM-dd"))).when(k == 1, F.upper(F.date_format(d, "dd-MMM-yyyy"))).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    return o.select("o_orderkey", V.parse_date(raw).cast("string").alias("parsed"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'INV-' || o_orderkey when 1 then case when length(o_orderkey::varchar) >= 3 then o_orderkey::varchar end when 2 then null else 'A' || o_orderkey || '/7' end as number from orders""")
def fn_invoice_number(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Invoice No: inv-"), key)).when(k == 1, F.concat(F.lit("#"), key)).when(k == 2, F.lit("Invoice Date 2012-03-06")).otherwise(F.concat(F.lit("a "), key, F.lit("/7")))
    return o.select("o_orderkey", V.invoice_number(raw).alias("number"))


@query("select o_orderkey, o_orderkey % 3 <> 2 as fits from orders")
def fn_po_shape(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(": #"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("PO-"), key)).otherwise(F.lit("no digits here"))
    return o.select("o_orderkey", V.order_identifier(raw).alias("fits"))


@query("select po_key, line_number, round(unit_price * 1.005, 2)::double as q2, round(cast(qty as decimal(18,4)) / 3, 4)::decimal(18,4) is not null as has from po_lines", "po_lines")
def fn_quantise(spark, sf):
    p = derived(spark, sf, "po_lines")
    return p.select("po_key", "line_number", V.quantise(F.col("unit_price") * F.lit("1.005").cast("decimal(4,3)")).cast("double").alias("q2"), V.quantise(F.col("qty").cast("decimal(18,4)") / 3, 4).isNotNull().alias("has"))


@query("select doc_id, sha256(text) as digest, true as valid from documents")
def fn_sha256(spark, sf):
    d = F.sha2(F.encode("text", "UTF-8"), 256)
    return _docs(spark, sf).select("doc_id", d.alias("digest"), T.is_sha256(d).alias("valid"))


@query(f"select po_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) as identity from (select po_key, sha1(from_hex('{NAMESPACE.hex}') || encode(concat_ws('|', po_number, supplier_id, currency))) as h from po) t", "po")
def fn_uuid5(spark, sf):
    return derived(spark, sf, "po").select("po_key", T.uuid5(NAMESPACE, F.concat_ws("|", "po_number", "supplier_id", "currency")).alias("identity"))


@query("select job_id, seq, case when seq <= 1 then 0.0 else least(1.0 * pow(2.0, seq - 2), 8.0) end as delay from jobs", "jobs")
def fn_retry_delay(spark, sf):
    return derived(spark, sf, "jobs").select("job_id", "seq", V.retry_delay(F.col("seq")).alias("delay"))


_RAW = """
  select document_id, 'TOTAL_AMOUNT' as field, concat('Total due: $', cast(total as string)) as raw from invoices where total is not null
  union all select document_id, 'INVOICE_DATE', concat('Date: ', cast(invoice_date as string)) from invoices
  union all select document_id, 'CURRENCY', case when currency is null then 'none' else concat(currency, ' amounts') end from invoices
  union all select document_id, 'SUPPLIER_NAME', concat('  ', supplier_name, '   Ltd ') from invoices where supplier_name is not null"""


@query(f"""select document_id, field, case field when 'TOTAL_AMOUNT' then 'DECIMAL' when 'INVOICE_DATE' then 'DATE' when 'CURRENCY' then 'CURRENCY_CODE' else 'TEXT' end as value_type,
   case field when 'CURRENCY' then upper(currency) when 'SUPPLIER_NAME' then supplier_name || ' Ltd' end as text_value, case when field = 'TOTAL_AMOUNT' then total::double end as decimal_value,
   case when field = 'INVOICE_DATE' then invoice_date::varchar end as date_value, not (field = 'CURRENCY' and currency is null) as fits from ({_RAW}) r join invoices using (document_id)""", "invoices")
def fn_typed_value(spark, sf):
    raw = spark.sql(_RAW.replace("from invoices", "from {invoices}"), invoices=derived(spark, sf, "invoices"))
    v = raw.select("document_id", "field", V.typed_value(F.col("field"), F.col("raw")).alias("v"), V.compatible(F.col("field"), F.col("raw")).alias("fits"))
    return v.select("document_id", "field", "v.value_type", "v.text_value", F.col("v.decimal_value").cast("double").alias("decimal_value"), F.col("v.date_value").cast("string").alias("date_value"), "fits")


# ---- validation ---------------------------------------------------------------------------

_FLAT = "document_id, 'invoice' as scope"
_NIL = "null::double as expected, null::double as observed"


@query(f"select {_FLAT}, case when currency is null or total is null then 'REVIEW_REQUIRED' else 'PASSED' end as status, {_NIL}, concat_ws('|', case when currency is null then 'REQUIRED_FINANCIAL_FIELD_MISSING:CURRENCY' end, case when total is null then 'REQUIRED_FINANCIAL_FIELD_MISSING:TOTAL_AMOUNT' end) as reasons from invoices", "invoices")
def required_check(spark, sf):
    return _checks(C.required_check(_inv(spark, sf)))


@query(f"""select {_FLAT}, case when total < 0 or n > 0 then 'FAILED' else 'PASSED' end as status, {_NIL}, concat_ws('|', case when total < 0 then 'UNEXPECTED_NEGATIVE_VALUE:TOTAL_AMOUNT' end, r) as reasons
  from invoices left join (select document_id, count(*) as n, string_agg('NEGATIVE_LINE_VALUE:' || line_number || ':quantity', '|' order by line_number) as r from inv_lines where quantity < 20 - 18 group by document_id) using (document_id)""", "invoices", "inv_lines")
def monetary_check(spark, sf):
    lines = derived(spark, sf, "inv_lines").withColumn("quantity", F.when(F.col("quantity") < 2, -F.col("quantity")).otherwise(F.col("quantity")))
    return _checks(C.monetary_check(_inv(spark, sf), lines))


@query(f"""select {_FLAT}, case when invoice_date_bad then 'REVIEW_REQUIRED' when not due_present then 'NOT_APPLICABLE' when due_early then 'FAILED' else 'PASSED' end as status, {_NIL},
  case when invoice_date_bad then 'INVALID_INVOICE_DATE' when due_present and due_early then 'DUE_DATE_BEFORE_INVOICE_DATE' else '' end as reasons from invoices""", "invoices")
def date_check(spark, sf):
    return _checks(C.date_check(_inv(spark, sf)))


@query(f"""select {_FLAT}, case when r in ('CURRENCY_MISSING', 'UNSUPPORTED_CURRENCY') then 'REVIEW_REQUIRED' when r <> '' then 'FAILED' else 'PASSED' end as status, {_NIL}, r as reasons from (
  select document_id, case when currency is null then 'CURRENCY_MISSING' when upper(currency) not in ('USD', 'GBP', 'EUR') then 'UNSUPPORTED_CURRENCY' when symbol = '$' and upper(currency) <> 'USD' then 'CONFLICTING_CURRENCY_EVIDENCE' else '' end as r from invoices)""", "invoices")
def currency_check(spark, sf):
    return _checks(C.currency_check(_inv(spark, sf)))


_ARITH = """select document_id, 'line-' || line_number as scope, case when unit_price is null or amount is null then 'SKIPPED' when abs(amount - round(quantity * unit_price, 2)) > 0.01 then 'FAILED' else 'PASSED' end as status,
  case when unit_price is not null and amount is not null then round(quantity * unit_price, 2)::double end as expected, case when unit_price is not null and amount is not null then amount::double end as observed,
  case when unit_price is null or amount is null then concat_ws('|', case when unit_price is null then 'LINE_ARITHMETIC_PREREQUISITE_MISSING:UNIT_PRICE' end, case when amount is null then 'LINE_ARITHMETIC_PREREQUISITE_MISSING:LINE_AMOUNT' end)
  when abs(amount - round(quantity * unit_price, 2)) > 0.01 then 'LINE_AMOUNT_MISMATCH' else '' end as reasons from inv_lines"""


@query(f"{_ARITH} union all select document_id, 'no-line-items', 'NOT_APPLICABLE', null, null, 'NO_LINE_ITEMS' from invoices where document_id not in (select document_id from inv_lines)", "invoices", "inv_lines")
def line_arithmetic(spark, sf):
    return _checks(C.line_arithmetic(_inv(spark, sf), derived(spark, sf, "inv_lines")))


@query(f"""select {_FLAT}, case when n is null then 'NOT_APPLICABLE' when subtotal is null or m > 0 then 'SKIPPED' when abs(subtotal - s) > 0.01 then 'FAILED' else 'PASSED' end as status,
  case when n is not null and subtotal is not null and m = 0 then s::double end as expected, case when n is not null then subtotal::double end as observed,
  case when n is null then 'NO_LINE_ITEMS' when subtotal is null then 'SUBTOTAL_MISSING' when m > 0 then r when abs(subtotal - s) > 0.01 then 'LINE_ITEMS_SUBTOTAL_MISMATCH' else '' end as reasons
  from invoices left join (select document_id, count(*) as n, count(*) filter (amount is null) as m, sum(amount) as s, string_agg('LINE_AMOUNT_MISSING:' || line_number, '|' order by line_number) filter (amount is null) as r from inv_lines group by document_id) using (document_id)""", "invoices", "inv_lines")
def subtotal_check(spark, sf):
    return _checks(C.subtotal_check(_inv(spark, sf), derived(spark, sf, "inv_lines")))


_DUE = "(subtotal - abs(coalesce(discount, 0)) + coalesce(tax, 0) + coalesce(shipping, 0))"


@query(f"""select {_FLAT}, case when subtotal is null then 'SKIPPED' when total is null then 'REVIEW_REQUIRED' when abs(total - {_DUE}) > 0.01 then 'FAILED' else 'PASSED' end as status, {_DUE}::double as expected, total::double as observed,
  case when subtotal is null then 'SUBTOTAL_REQUIRED_FOR_TOTAL_CHECK' when total is null then 'TOTAL_AMOUNT_MISSING|CALCULATED_TOTAL_NOT_PERSISTED' when abs(total - {_DUE}) > 0.01 then 'INVOICE_TOTAL_MISMATCH' else '' end as reasons from invoices""", "invoices")
def total_check(spark, sf):
    return _checks(C.total_check(_inv(spark, sf)))


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return C.all_checks(_inv(spark, sf), derived(spark, sf, "inv_lines"))


_STATUSES = f"""
 with l as ({_ARITH} union all select document_id, 'no-line-items', 'NOT_APPLICABLE', null, null, 'NO_LINE_ITEMS' from invoices where document_id not in (select document_id from inv_lines)),
 a as (select document_id, count(*) as n, count(*) filter (amount is null) as m, sum(amount) as s from inv_lines group by document_id),
 c as (select document_id, status from l
  union all select document_id, case when inherited_review then 'REVIEW_REQUIRED' else 'PASSED' end from invoices
  union all select document_id, case when currency is null or total is null then 'REVIEW_REQUIRED' else 'PASSED' end from invoices
  union all select document_id, case when total < 0 then 'FAILED' else 'PASSED' end from invoices
  union all select document_id, case when invoice_date_bad then 'REVIEW_REQUIRED' when not due_present then 'NOT_APPLICABLE' when due_early then 'FAILED' else 'PASSED' end from invoices
  union all select document_id, case when currency is null or upper(currency) not in ('USD', 'GBP', 'EUR') then 'REVIEW_REQUIRED' when symbol = '$' and upper(currency) <> 'USD' then 'FAILED' else 'PASSED' end from invoices
  union all select document_id, case when n is null then 'NOT_APPLICABLE' when subtotal is null or m > 0 then 'SKIPPED' when abs(subtotal - s) > 0.01 then 'FAILED' else 'PASSED' end from invoices left join a using (document_id)
  union all select document_id, case when subtotal is null then 'SKIPPED' when total is null then 'REVIEW_REQUIRED' when abs(total - {_DUE}) > 0.01 then 'FAILED' else 'PASSED' end from invoices)"""


@query(f"""{_STATUSES} select document_id, count(*) as performed, count(*) filter (status = 'PASSED') as passed, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'REVIEW_REQUIRED') as review_required,
  count(*) filter (status = 'NOT_APPLICABLE') as not_applicable, count(*) filter (status = 'SKIPPED') as skipped, case when count(*) filter (status in ('FAILED', 'REVIEW_REQUIRED', 'SKIPPED')) > 0 then 'REVIEW_REQUIRED' else 'SUCCEEDED' end as overall from c group by document_id""", "invoices", "inv_lines")
def validation_summary(spark, sf):
    return C.summarise(_all(spark, sf))


_REASONED = """ union all """.join(f"select document_id, scope, status, reasons, {k} as p, '{check}' as check_type from ({sql}) c{k}" for k, (check, sql) in enumerate([
    ("INHERITED_REVIEW", "select document_id, 'invoice' as scope, case when inherited_review then 'REVIEW_REQUIRED' else 'PASSED' end as status, case when inherited_review then 'INHERITED_REVIEW_REQUIRED|INHERITED_NORMALIZATION_REVIEW' else '' end as reasons from invoices"),
    ("REQUIRED_FINANCIAL_FIELDS", RAW["required_check"]),
    ("MONETARY_VALUE_VALIDITY", "select document_id, 'invoice' as scope, case when total < 0 then 'FAILED' else 'PASSED' end as status, case when total < 0 then 'UNEXPECTED_NEGATIVE_VALUE:TOTAL_AMOUNT' else '' end as reasons from invoices"),
    ("DATE_CONSISTENCY", RAW["date_check"]), ("CURRENCY_CONSISTENCY", RAW["currency_check"]), ("LINE_ITEM_ARITHMETIC", RAW["line_arithmetic"]), ("LINE_ITEMS_TO_SUBTOTAL", RAW["subtotal_check"]), ("INVOICE_TOTAL_RECONCILIATION", RAW["total_check"]),
]))


@query(f"""with c as ({_REASONED}), bad as (select *, coalesce(try_cast(replace(scope, 'line-', '') as integer), 0) as l, string_split(case when reasons = '' then check_type || '_' || status else reasons end, '|') as r from c where status in ('FAILED', 'REVIEW_REQUIRED', 'SKIPPED')),
  each as (select document_id, p, l, unnest(r) as reason, unnest(range(1, len(r) + 1)) as k from bad), firsts as (select document_id, reason, min((p, l, k)) as place from each group by all)
  select document_id, string_agg(reason, '|' order by place) as reasons from firsts group by document_id""", "invoices", "inv_lines")
def validation_reasons(spark, sf):
    return C.review_reasons(_all(spark, sf)).select("document_id", F.array_join("reasons", "|").alias("reasons"))


@query(f"{_STATUSES} select status, count(*) as n from c group by status", "invoices", "inv_lines")
def check_histogram(spark, sf):
    return _all(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


# ---- matching -----------------------------------------------------------------------------


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "suppliers").withColumn("aliases", F.array("alias"))


_KEY = "upper(trim(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')))"


@query(f"select document_id, supplier_id, 'ALIAS' as method from invoices join suppliers s on {_KEY.format('supplier_name')} = {_KEY.format('s.alias')}", "invoices", "suppliers")
def supplier_exact(spark, sf):
    return M.exact_suppliers(derived(spark, sf, "invoices"), _suppliers(spark, sf))


#: The longest common run of a and b, the first in a and then in b: its length, and its places negated.
_RUN = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: {'k': list_max(list_filter(range(0, least(length(a) - i, length(b) - j) + 2), lambda n: substr(a, i, n) = substr(b, j, n))), 'i': -i, 'j': -j}))))"""
#: Names against supplier names: matching-blocks ratios of the pairs whose edit distance allows 0.9, by splitting at the longest common run.
_NAMES = """
 with recursive n as (select distinct supplier_name, """ + _KEY.format("supplier_name") + """ as k from invoices where supplier_name is not null),
 s as (select supplier_id, active, approved, """ + _KEY.format("legal_name") + """ as k from suppliers union select supplier_id, active, approved, """ + _KEY.format("alias") + """ from suppliers),
 near as (select distinct n.k as x, s.k as y from n join s on n.k <> s.k and levenshtein(n.k, s.k) <= 0.1 * (length(n.k) + length(s.k))),
 seg as (select x, y, x as a, y as b from near union all
   select x, y, case side when 1 then left(a, -f.i - 1) else substr(a, f.k - f.i) end, case side when 1 then left(b, -f.j - 1) else substr(b, f.k - f.j) end
   from (select *, """ + _RUN + """ as f from seg where a <> '' and b <> '') t, (values (1), (2)) v(side) where f.k > 0),
 ratio as (select x, y, round(2.0 * sum((""" + _RUN + """).k) / (length(x) + length(y)), 4) as score from seg where a <> '' and b <> '' group by x, y union all select distinct k, k, 1.0 from n),
 p as (select supplier_name, supplier_id, active, approved, max(score)::double as score from n join ratio on x = n.k join s on y = s.k group by all),
 r as (select *, row_number() over (partition by supplier_name order by score desc, supplier_id desc) as rank from p where score >= 0.9)"""


@query(f"{_NAMES} select supplier_name, supplier_id, score::double as score, rank::integer as rank from r where rank <= 5", "invoices", "suppliers")
def supplier_fuzzy(spark, sf):
    return M.score_suppliers(derived(spark, sf, "invoices"), _suppliers(spark, sf)).select("supplier_name", "supplier_id", "score", "rank")


_ADDRESSED = """
 with recursive sp as (select s_suppkey as k, concat('SUP-', cast(s_suppkey as string)) as supplier_id, substr(md5(cast(s_suppkey as string)), 1, 20) as legal_name, concat('12 ', substr(md5(concat('a', cast(s_suppkey as string))), 1, 12), ' Street') as address from supplier),
 asked as (select k as document_id, substr(legal_name, 1, cast(20 - k % 6 as int)) as supplier_name, case k % 4 when 0 then address when 1 then replace(address, 'Street', 'Streat') when 2 then concat('99 ', substr(md5(concat('b', cast(k as string))), 1, 12), ' Lane') end as supplier_address from sp),
 offered as (select supplier_id, legal_name, address from sp union all select concat('TWIN-', cast(k as string)), substr(legal_name, 1, 18), supplier_address from sp join asked on document_id = k where k % 10 = 0)"""


@query(_ADDRESSED + """,
 n as (select *, """ + _KEY.format("supplier_name") + " as k, " + _KEY.format("coalesce(supplier_address, '')") + """ as a from asked), s as (select *, """ + _KEY.format("legal_name") + " as k, " + _KEY.format("coalesce(address, '')") + """ as a from offered),
 near as (select distinct n.k as x, s.k as y from n join s on n.k <> s.k and levenshtein(n.k, s.k) <= 0.13 * (length(n.k) + length(s.k)) + 1e-9
   union select n.a, s.a from n join s on n.a <> s.a and n.a <> '' and s.a <> '' and levenshtein(n.a, s.a) <= 0.1 * (length(n.a) + length(s.a)) + 1e-9),
 seg as (select x, y, x as a, y as b from near union all
   select x, y, case side when 1 then left(a, -f.i - 1) else substr(a, f.k - f.i) end, case side when 1 then left(b, -f.j - 1) else substr(b, f.k - f.j) end
   from (select *, """ + _RUN + """ as f from seg where a <> '' and b <> '') t, (values (1), (2)) v(side) where f.k > 0),
 ratio as (select x, y, round(2.0 * sum((""" + _RUN + """).k) / (length(x) + length(y)), 4) as score from seg where a <> '' and b <> '' group by x, y),
 p as (select document_id, supplier_id, least(1, case when n.k = s.k then 1.0 else r.score end + case when n.a <> '' and (n.a = s.a or q.score >= 0.9) then 0.03 else 0 end)::double as score
   from n cross join s left join ratio r on r.x = n.k and r.y = s.k left join ratio q on q.x = n.a and q.y = s.a where n.k = s.k or r.score >= 0.87),
 o as (select *, row_number() over (partition by document_id order by score desc, supplier_id desc) as rank, lead(score) over (partition by document_id order by score desc, supplier_id desc) as second from p where score >= 0.9)
 select document_id, case when score is null then 'NOT_FOUND' when second is not null and round(score - second, 4) <= 0.05 then 'AMBIGUOUS' else 'MATCHED' end as supplier_status, case when second is null or round(score - second, 4) > 0.05 then supplier_id end as supplier_id, score as supplier_score
 from n left join (select * from o where rank = 1) o using (document_id)""")
def supplier_addresses(spark, sf):
    """Names that an address lifts over the threshold, and some that it makes ambiguous."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    text = _ADDRESSED.replace("with recursive", "with").replace("from supplier)", "from {supplier})")
    asked, offered = (spark.sql(f"{text} select * from {t}", supplier=supplier) for t in ("asked", "offered"))
    addresses = F.when(F.col("address").isNotNull(), F.array("address"))
    suppliers = offered.select("supplier_id", "legal_name", F.lit(None).cast("array<string>").alias("aliases"), addresses.alias("addresses"), F.lit(True).alias("active"), F.lit(True).alias("approved"))
    return M.resolve_suppliers(asked, suppliers).select("document_id", "supplier_status", "supplier_id", "supplier_score")


_RESOLVED = _NAMES + """,
 t as (select supplier_name, max(case when rank = 1 then supplier_id end) as sid, max(case when rank = 1 then score end) as a, max(case when rank = 2 then score end) as b, bool_or(rank = 1 and active) as active, bool_or(rank = 1 and approved) as approved from r where rank <= 5 group by supplier_name),
 sup as (select document_id, supplier_name, sid, case when a is null then 'NOT_FOUND' when b is not null and round(a - b, 4) <= 0.05 then 'AMBIGUOUS' when not active or not approved then 'CONFLICT' else 'MATCHED' end as st, a, active, approved from invoices left join t using (supplier_name)),
 supr as (select document_id, st as supplier_status, case when st in ('MATCHED', 'CONFLICT') then sid end as supplier_id,
   case when supplier_name is null then 'SUPPLIER_NAME_MISSING' when st = 'NOT_FOUND' then 'APPROVED_SUPPLIER_NOT_FOUND' when st = 'AMBIGUOUS' then 'AMBIGUOUS_SUPPLIER_MATCH' when not active then 'SUPPLIER_INACTIVE' when not approved then 'SUPPLIER_NOT_APPROVED_FOR_PAYMENT' end as supplier_reason from sup)"""


@query(f"{_RESOLVED} select * from supr", "invoices", "suppliers")
def supplier_resolution(spark, sf):
    return M.resolve_suppliers(derived(spark, sf, "invoices"), _suppliers(spark, sf)).drop("supplier_score")


_ORDERS = _RESOLVED + """,
 key as (select document_id, po_reference, upper(regexp_replace(regexp_replace(po_reference, '^(PO No\\.: |PO-)', ''), '[^A-Za-z0-9]', '', 'g')) as k from invoices),
 por as (select document_id, po_reference, po_key, case when po_reference is null then null when po_key is null then 'REFERENCED_PURCHASE_ORDER_NOT_FOUND' when r.supplier_id is not null and r.supplier_id <> po.supplier_id then 'PURCHASE_ORDER_SUPPLIER_CONFLICT'
    when state = 'CANCELLED' then 'PURCHASE_ORDER_CANCELLED' when state = 'CLOSED' then 'PURCHASE_ORDER_CLOSED' end as po_reason from key join supr r using (document_id) left join po on k = po_key::varchar),
 pos as (select document_id, case when po_reference is null then 'NOT_REFERENCED' when po_key is null then 'NOT_FOUND' when po_reason is not null then 'CONFLICT' else 'MATCHED' end as po_status, po_key, po_reason from por)"""


class _Tables:
    """Derived tables by name, and results kept in a folder that all executors share.

    The lines and heads of orders, which all other tables come from, are worked
    out once, and so is each resolution, however many joins read it.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.folder = spark, sf, fresh_folder(spark, "orders")
        self.held = held_tables(spark, sf, self.folder, "po_lines", "po")

    def __call__(self, name: str) -> DataFrame:
        return derived(self.spark, self.sf, name, self.held)

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return spread(self.spark.read.parquet(f"{self.folder}/{name}"))


def _resolved(spark: SparkSession, sf: str, get: _Tables) -> tuple:
    inv = _inv(spark, sf, get)
    sup = get.keep("supplier_results", M.resolve_suppliers(inv, _suppliers(spark, sf)))
    return inv, sup, get.keep("order_results", M.resolve_orders(inv, get("po"), sup))


@query(f"{_ORDERS} select * from pos", "invoices", "suppliers", "po")
def po_resolution(spark, sf):
    return _resolved(spark, sf, _Tables(spark, sf))[2]


_RECEIPTS = _ORDERS + """,
 h as (select g.po_key, count(*) filter (g.state = 'POSTED') as posted, count(*) filter (g.state = 'REVERSED') as reversed, count(*) filter (g.state = 'POSTED' and g.supplier_id <> po.supplier_id) as other from gr g join po using (po_key) group by g.po_key),
 stray as (select distinct l.po_key from gr_lines l join gr on gr.goods_receipt_id = l.goods_receipt_id and gr.state = 'POSTED' where not exists (select 1 from po_lines p where p.po_key = l.po_key and p.line_number = l.po_line_number)),
 grs as (select document_id, po_status, requires_goods_receipt as req, case when po_status = 'MATCHED' and requires_goods_receipt then case when coalesce(posted, 0) = 0 and coalesce(reversed, 0) > 0 then 'GOODS_RECEIPT_REVERSED' when coalesce(posted, 0) = 0 then 'REQUIRED_GOODS_RECEIPT_NOT_FOUND'
    when other > 0 then 'GOODS_RECEIPT_SUPPLIER_CONFLICT' when stray.po_key is not null then 'GOODS_RECEIPT_LINE_NOT_IN_PO' end end as gr_reason, coalesce(posted, 0) as posted
    from pos left join po using (po_key) left join h using (po_key) left join stray using (po_key)),
 grr as (select document_id, case when po_status <> 'MATCHED' or not req then 'NOT_REFERENCED' when posted = 0 then 'NOT_FOUND' when gr_reason is not null then 'CONFLICT' else 'MATCHED' end as gr_status, gr_reason,
    case when po_status <> 'MATCHED' then 'UNDETERMINED' when req then 'THREE_WAY' else 'TWO_WAY' end as match_mode from grs)"""
_FIVE = ("invoices", "suppliers", "po", "gr_lines", "inv_lines")


def _receipts(get: _Tables, orders: DataFrame) -> DataFrame:
    return get.keep("receipt_results", M.resolve_receipts(orders, *(get(t) for t in ("po", "po_lines", "gr", "gr_lines"))))


@query(f"{_RECEIPTS} select * from grr", *_FIVE)
def gr_resolution(spark, sf):
    get = _Tables(spark, sf)
    return _receipts(get, _resolved(spark, sf, get)[2])


@query("select l.po_key, po_line_number as line_number, sum(quantity_received)::double as received from gr_lines l join gr on gr.goods_receipt_id = l.goods_receipt_id where gr.state = 'POSTED' group by all", "gr_lines")
def received_qty(spark, sf):
    return M.received_quantities(derived(spark, sf, "gr"), derived(spark, sf, "gr_lines")).withColumn("received", F.col("received").cast("double"))


def _line_inputs(spark: SparkSession, sf: str, get, orders: DataFrame, receipts: DataFrame) -> DataFrame:
    """Lines of invoices with a matched order, beside the order line that each is assigned to."""
    matched = orders.filter("po_status = 'MATCHED'").select("document_id", "po_key").join(receipts.select("document_id", "match_mode"), "document_id")
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("po_description"))
    po_lines = get("po_lines").join(part, "part_key").select("po_key", F.col("line_number").alias("po_line_number"), F.col("qty").cast("decimal(18,4)").alias("po_qty"), F.col("unit_price").alias("po_price"), F.col("line_total").alias("po_total"), "po_description")
    got = M.received_quantities(get("gr"), get("gr_lines")).withColumnRenamed("line_number", "po_line_number")
    lines = get("inv_lines").join(matched, "document_id")
    return M.with_order_lines(lines, po_lines).join(got, ["po_key", "po_line_number"], "left")


_LINES = _RECEIPTS + """,
 rq as (select l.po_key, po_line_number as line_number, sum(quantity_received) as received from gr_lines l join gr on gr.goods_receipt_id = l.goods_receipt_id where gr.state = 'POSTED' group by all),
 li as (select i.document_id, i.line_number, i.quantity, i.unit_price, i.amount, p.qty::decimal(18,4) as oq, p.unit_price as up, received, match_mode, round(i.quantity * p.unit_price, 2) as due
    from inv_lines i join pos on pos.document_id = i.document_id and po_status = 'MATCHED' join grr on grr.document_id = i.document_id join po_lines p on p.po_key = pos.po_key and p.line_number = i.line_number left join rq on rq.po_key = pos.po_key and rq.line_number = i.line_number),
 ev as (select document_id, line_number, line_number as po_line_number, 'PASSED' as description_status,
    case when match_mode = 'THREE_WAY' and received is null then 'REVIEW_REQUIRED' when quantity <= case when match_mode = 'THREE_WAY' then least(oq, received) else oq end + 0.0001 then 'PASSED' else 'FAILED' end as quantity_status,
    case when unit_price is null then 'REVIEW_REQUIRED' when abs(unit_price - up) <= 0.01 then 'PASSED' else 'FAILED' end as unit_price_status,
    case when amount is null then 'REVIEW_REQUIRED' when abs(amount - due) <= 0.01 then 'PASSED' else 'FAILED' end as line_total_status,
    case when match_mode <> 'THREE_WAY' or received is not null then (quantity - case when match_mode = 'THREE_WAY' then least(oq, received) else oq end)::double end as quantity_variance, (unit_price - up)::double as unit_price_variance, (amount - due)::double as line_total_variance, match_mode
    from li),
 ev2 as (select *, concat_ws('|', case when quantity_status = 'REVIEW_REQUIRED' then 'RECEIVED_QUANTITY_MISSING' when quantity_status = 'FAILED' and match_mode = 'THREE_WAY' then 'INVOICE_QUANTITY_EXCEEDS_ORDER_OR_RECEIPT' when quantity_status = 'FAILED' then 'INVOICE_QUANTITY_EXCEEDS_PURCHASE_ORDER' end,
    case unit_price_status when 'REVIEW_REQUIRED' then 'INVOICE_LINE_UNIT_PRICE_MISSING' when 'FAILED' then 'UNIT_PRICE_VARIANCE_EXCEEDS_TOLERANCE' end, case line_total_status when 'REVIEW_REQUIRED' then 'INVOICE_LINE_TOTAL_MISSING' when 'FAILED' then 'LINE_TOTAL_VARIANCE_EXCEEDS_TOLERANCE' end) as reasons from ev)"""


def _line_rows(spark: SparkSession, sf: str, get, orders: DataFrame, receipts: DataFrame) -> DataFrame:
    return M.evaluate_lines(_line_inputs(spark, sf, get, orders, receipts))


@query(f"{_LINES} select * exclude (match_mode) from ev2", *_FIVE)
def line_eval(spark, sf):
    get = _Tables(spark, sf)
    orders = _resolved(spark, sf, get)[2]
    rows = _line_rows(spark, sf, get, orders, _receipts(get, orders)).withColumn("reasons", F.array_join("reasons", "|"))
    return rows.select(*[F.col(c).cast("double").alias(c) if c.endswith("variance") else F.col(c) for c in rows.columns])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("po_description"))
    po = derived(spark, sf, "po_lines").join(part, "part_key").select(F.col("po_key").alias("document_id"), F.col("line_number").alias("po_line_number"), "po_description")
    return derived(spark, sf, "inv_lines").select("document_id", "line_number", "description").join(po, "document_id")


@query("select document_id, line_number, line_number as po_line_number, 1.0::double as score, 'DESCRIPTION' as method from inv_lines", "inv_lines")
def line_greedy(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("po_description"))
    po = derived(spark, sf, "po_lines").join(part, "part_key").select("po_key", F.col("line_number").alias("po_line_number"), "po_description")
    return M.match_lines(derived(spark, sf, "inv_lines").select("document_id", F.col("document_id").alias("po_key"), "line_number", "description"), po)


@query(f"select document_id, i.line_number, p.line_number as po_line_number, i.description = q.p_name as same from inv_lines i join po_lines p on p.po_key = i.document_id join part q on q.p_partkey = p.part_key", "inv_lines")
def line_candidates(spark, sf):
    return _pairs(spark, sf).select("document_id", "line_number", "po_line_number", (F.col("description") == F.col("po_description")).alias("same"))


_SUMMARY = _LINES + """,
 ro as (select document_id, bool_or('FAILED' in (quantity_status, unit_price_status, line_total_status)) as bad, bool_or('REVIEW_REQUIRED' in (quantity_status, unit_price_status, line_total_status)) as ask from ev group by document_id),
 sm as (select i.document_id, match_mode, inherited_review, case supplier_status when 'MATCHED' then 'PASSED' else 'REVIEW_REQUIRED' end as supplier_check, case po_status when 'MATCHED' then 'PASSED' when 'NOT_REFERENCED' then 'NOT_APPLICABLE' else 'REVIEW_REQUIRED' end as po_check,
    case when match_mode <> 'THREE_WAY' then 'NOT_APPLICABLE' when gr_status = 'MATCHED' then 'PASSED' else 'REVIEW_REQUIRED' end as receipt_check,
    case when po_status <> 'MATCHED' then 'NOT_APPLICABLE' when i.currency is null then 'REVIEW_REQUIRED' when upper(i.currency) = po.currency then 'PASSED' else 'FAILED' end as currency_check,
    case when po_status <> 'MATCHED' then 'NOT_APPLICABLE' when bad is null then 'REVIEW_REQUIRED' when bad then 'FAILED' when ask then 'REVIEW_REQUIRED' else 'PASSED' end as lines_check,
    case when po_status <> 'MATCHED' then 'NOT_APPLICABLE' when subtotal is null then 'REVIEW_REQUIRED' when abs(subtotal - po.total_amount) <= 0.01 then 'PASSED' else 'FAILED' end as total_check
    from invoices i join supr using (document_id) join pos using (document_id) join grr using (document_id) left join po using (po_key) left join ro using (document_id)),
 fin as (select * exclude (inherited_review), len(list_filter([supplier_check, po_check, receipt_check, currency_check, lines_check, total_check], lambda x: x = 'PASSED')) as passed,
    len(list_filter([supplier_check, po_check, receipt_check, currency_check, lines_check, total_check], lambda x: x = 'FAILED')) as failed, len(list_filter([supplier_check, po_check, receipt_check, currency_check, lines_check, total_check], lambda x: x = 'REVIEW_REQUIRED')) as review,
    len(list_filter([supplier_check, po_check, receipt_check, currency_check, lines_check, total_check], lambda x: x = 'NOT_APPLICABLE')) as skipped, inherited_review from sm)"""


def match_all(spark: SparkSession, sf: str) -> DataFrame:
    get = _Tables(spark, sf)
    inv, sup, orders = _resolved(spark, sf, get)
    receipts = _receipts(get, orders)
    return M.summarise_matches(inv, sup, orders, receipts, _line_rows(spark, sf, get, orders, receipts), get("po"))


@query(f"{_SUMMARY} select * exclude (inherited_review), case when failed + review > 0 or inherited_review then 'REVIEW_REQUIRED' else 'SUCCEEDED' end as overall from fin", *_FIVE)
def three_way_match(spark, sf):
    """Flagship: every invoice against suppliers, orders and receipts."""
    return match_all(spark, sf).drop("reasons")


@query(f"{_SUMMARY} select match_mode, count(*) as n, sum(passed)::bigint as passed, sum(failed)::bigint as failed, sum(review)::bigint as review, sum(skipped)::bigint as skipped from fin group by match_mode", *_FIVE)
def match_mode(spark, sf):
    return match_all(spark, sf).groupBy("match_mode").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("passed", "failed", "review", "skipped")])


_REASONS = _SUMMARY + """,
 lr as (select document_id, flatten(list(string_split(reasons, '|') order by line_number)) as l from ev2 group by document_id),
 mr as (select sm.document_id, sm.inherited_review, [supplier_reason, po_reason, gr_reason, case currency_check when 'REVIEW_REQUIRED' then 'INVOICE_CURRENCY_MISSING' when 'FAILED' then 'INVOICE_PO_CURRENCY_CONFLICT' end]
     || case when po_status <> 'MATCHED' then [] when lr.l is null then ['NO_INVOICE_LINES_AVAILABLE_FOR_MATCHING'] else lr.l end
     || [case total_check when 'REVIEW_REQUIRED' then 'INVOICE_SUBTOTAL_MISSING_FOR_PO_MATCH' when 'FAILED' then 'PO_TOTAL_VARIANCE_EXCEEDS_TOLERANCE' end, case when sm.inherited_review then 'INHERITED_FINANCIAL_VALIDATION_REVIEW' end] as l
   from sm join supr using (document_id) join pos using (document_id) join grr using (document_id) left join lr using (document_id)),
 rs as (select document_id, array_to_string(list_filter(l, lambda x, i: x is not null and x <> '' and list_position(l, x) = i), '|') as reasons from mr)"""


@query(f"{_REASONS} select document_id, reasons from rs", *_FIVE)
def match_reasons(spark, sf):
    return match_all(spark, sf).select("document_id", F.array_join("reasons", "|").alias("reasons"))
