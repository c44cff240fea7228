"""From evidence lines to typed invoice fields: all candidate streams with their evidence, one ranking, nested documents."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.text import clean_text, comparison_key, uuid5
from tallybook.functions.values import CODES, SYMBOLS, currency_code, money, parse_decimal, typed_value
from tallybook.operators import layout as L
from tallybook.sources.shared import kept

#: Names the identities of candidates, fields and lines; versions of the rules have identities of their own.
NAMESPACE, VERSION = uuid.UUID("5f0c2f64-6a0e-5d0c-9d5e-2b8f5a3c7e11"), "fields-1"
# Fields a document must have, all fields in their order, and the least confidence that needs no review.
REQUIRED = ["SUPPLIER_NAME", "INVOICE_NUMBER", "INVOICE_DATE", "CURRENCY", "TOTAL_AMOUNT"]
FIELDS = [
    "SUPPLIER_NAME", "SUPPLIER_ADDRESS", "CUSTOMER_NAME", "CUSTOMER_ADDRESS", "INVOICE_NUMBER", "INVOICE_DATE", "DUE_DATE", "PURCHASE_ORDER_NUMBER",
    "CURRENCY", "SUBTOTAL", "TAX_AMOUNT", "DISCOUNT_AMOUNT", "SHIPPING_AMOUNT", "TOTAL_AMOUNT", "PAYMENT_TERMS",
]
LEAST_CONFIDENCE = 70
NO_TEXTS = "array<string>"


def _within(confidence: Column) -> Column:
    return F.round(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(100.0)), 2)


def joint_confidence(confidences: Column) -> Column:
    """Mean over an array of distinct references' confidences, each and all from 0 to 100, two places; 0 without any."""
    bounded = F.transform(confidences, lambda c: F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(100.0)))
    return F.when(F.size(confidences) == 0, F.lit(0.0)).otherwise(F.round(F.aggregate(bounded, F.lit(0.0), lambda a, c: a + c) / F.size(confidences), 2))


def identity(kind: str, *parts: Column) -> Column:
    """A reproducible identity from the version, the kind and the parts' texts."""
    return uuid5(NAMESPACE, F.concat_ws("|", F.lit(VERSION), F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _found(raw: Column, refs: Column, confidences: Column, adjust: Column, method: str, rule: str, order: int, rank: Column | int = 0) -> Column:
    """A candidate of one way of finding values; seq: place of the way, then of its label and rank."""
    place = F.col("page") * 10_000_000 + F.col("line_order") * 10 + rank
    return F.struct(
        raw.alias("raw"), _within(joint_confidence(confidences) + adjust).alias("confidence"), F.lit(method).alias("method"), F.lit(rule).alias("rule"),
        refs.alias("evidence"), (F.lit(order * 10**15) + place).cast("long").alias("seq"),
    )


def candidates(lines: DataFrame, every: bool = False) -> DataFrame:
    """All candidates of all fields: (document_id, field, raw, value, value_type, confidence, method, rule, evidence, seq, candidate_id).

    Typed fields: inline and beside their label. Parties: inline and below; terms: inline, with no other label inside;
    addresses: inline and up to four lines below. Currency: any line that shows a code or symbol. Parties without a
    label: the page's header. Each names the lines it rests on; its confidence is their mean, adjusted by kind and rank.
    lines: rows, or pages. A page's lines stay in one row until its candidates are found, so lines are read once, and rows
    remain dealt by document. every: a row without a field for each page, so that no document is lost.
    """
    header = F.when(F.col("page") == 1, L.header_lines()).otherwise(F.array())
    pages = L.with_references(L.pages_of(lines)).select(*L.PAGE, "lines", F.explode(F.array(header)).alias("_header"))
    rows = pages.select("*", F.posexplode("lines").alias("_at", "_l")).select(*L.PAGE, "lines", "_header", "_at", "_l.*")
    rows = rows.withColumn("key", F.explode(F.array(comparison_key(F.col("text")))))
    codes, signs = "|".join(CODES), "".join(x for x, _ in SYMBOLS if len(x) == 1)
    shown = F.col("text").rlike(f"(?i)(?:{codes})|[{signs}]") & currency_code(F.col("text")).isNotNull()
    # what a line is asked for: the fields it labels, a currency, a party of the header, and the page itself
    label, key, at = L.fields_of_key(F.col("key")), F.col("key"), F.col("line_order")
    way = lambda name, field, when: F.when(when, F.struct(F.lit(name).alias("way"), field.alias("field")))
    named = [way("label", label[k], (key != "") & label[k].isNotNull()) for k in range(len(L.LABELS))]
    parties = [way("header", F.lit(f), F.exists("_header", lambda p: (p["field"] == f) & (p["v"]["line_order"] == at))) for f in L.PARTIES]
    alone = [way("currency", F.lit("CURRENCY"), shown)] + ([way("page", F.lit(None).cast("string"), F.col("_at") == 0)] if every else [])
    asked = rows.select("*", F.inline(F.array_compact(F.array(*named, *parties, *alone))))  # a row copies its page

    field, text, ref, own = (F.col(c) for c in ("field", "text", "reference_id", "confidence"))
    by_code = F.when(text.rlike(f"(?i)(?<![A-Z])(?:{codes})(?![A-Z])"), 6.0).otherwise(0.0)
    in_total = F.when(F.col("key").rlike("TOTAL|BALANCEDUE|AMOUNTDUE"), 4.0).otherwise(0.0)
    both = lambda name, v: F.array(F.col(name), v[name])
    ranked = lambda found, adjust, rule, order: F.transform(found, lambda b, i: _found(b["v"]["text"], both("reference_id", b["v"]), both("confidence", b["v"]), -2.0 * i + adjust(b), "SPATIAL_PROXIMITY", rule, order, i + 1))
    behind = F.filter(L.behind(field, text), lambda v: (field != "PAYMENT_TERMS") | ~L.shows_label(v))
    inline = F.transform(behind, lambda v: _found(v, F.array(ref), F.array(own), F.lit(2.0), "LABEL_VALUE", "inline", 1))
    beside = ranked(L.beside(), lambda b: F.when(b["same_row"], 1.0).otherwise(0.0), "beside", 2)
    below = ranked(L.below(), lambda b: F.lit(0.0), "below", 3)
    lined = lambda parts, name: F.concat(F.array(F.col(name)), F.transform(parts, lambda v: v[name]))
    address = F.transform(F.filter(F.array(L.address_lines()), lambda a: F.size(a) > 0), lambda a: _found(L.joined_address(a, "text"), lined(a, "reference_id"), lined(a, "confidence"), F.lit(0.0), "COMBINED_RULES", "address", 4))
    by_label = F.when(field.isin(L.TYPED), F.concat(inline, beside)).when(field.isin(L.PARTIES), F.concat(inline, below)).when(field.isin(L.ADDRESSES), F.concat(inline, address)).otherwise(inline)
    currency = _found(text, F.array(ref), F.array(own), by_code + in_total, "REGULAR_EXPRESSION", "currency", 5)
    party = _found(text, F.array(ref), F.array(own), F.lit(-8.0), "COMBINED_RULES", "header", 6)
    none = _found(F.lit(None).cast("string"), F.array(ref), F.array(own), F.lit(0.0), "COMBINED_RULES", "page", 7)
    found = F.when(F.col("way") == "label", by_label).when(F.col("way") == "currency", F.array(currency)).when(F.col("way") == "header", F.array(party)).otherwise(F.array(none))
    told = asked.select("document_id", "field", F.inline(found))
    # exploding keeps the optimiser from writing a value's rules once for each use of it
    told = told.withColumn("raw", F.explode(F.array(clean_text(F.col("raw")))))
    typed = told.withColumn("v", F.explode(F.array(typed_value(F.col("field"), F.col("raw")))))
    value = F.coalesce(F.col("v.text_value"), F.col("v.decimal_value").cast("string"), F.col("v.date_value").cast("string"))
    named = typed.withColumn("value", value).filter("field is null or value is not null and value <> ''").withColumn("value_type", F.col("v.value_type")).drop("v")
    return named.withColumn("candidate_id", identity("candidate", F.col("document_id"), F.col("field"), F.col("value"), F.array_join("evidence", "|"), F.col("rule")))


def fields(lines: DataFrame, every: bool = False) -> DataFrame:
    """One row per document and field: the best candidate with its evidence, the number of values found, notes and reasons.

    every: and one without a field for each document.
    """
    best = L.best_candidates(candidates(lines, every), tie="candidate_id")
    reasons = F.array_compact(F.array(F.when(F.col("confidence") < LEAST_CONFIDENCE, "LOW_FIELD_CONFIDENCE"), F.when(F.col("ambiguous"), "AMBIGUOUS_FIELD_CANDIDATES")))
    notes = F.array_compact(F.array(
        F.concat(F.lit("Selected by rule "), F.col("rule"), F.lit(".")), F.concat(F.lit("Candidate count: "), F.col("n_candidates").cast("string"), F.lit(".")), F.when(F.col("ambiguous"), "Other values lie within the ambiguity margin."),
    ))
    out = best.withColumn("reasons", reasons).withColumn("notes", notes).withColumn("review", F.size("reasons") > 0)
    return out.withColumn("field_id", identity("field", F.col("document_id"), F.col("field"), F.col("candidate_id"))).drop("seq")


def _in_order(field: str) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in FIELDS]), F.col(field))


#: What a document holds of each of its fields and of each of its lines.
FIELD = ["field", "raw", "value", "value_type", "confidence", "method", "evidence", "candidate_id", "notes", "reasons"]
ITEM = ["line_number", "page", "description", "quantity", "unit_price", "amount", "confidence", "evidence", "reasons"]


def _field_reasons(found: DataFrame, *more: Column) -> DataFrame:
    """(document_id, fields, field_reasons): each document's fields in their order, and what they give rise to; more: other aggregates."""
    listed = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct(_in_order("field").alias("_place"), *FIELD))))
    g = found.groupBy("document_id").agg(listed.alias("_listed"), *more)
    wanted = F.array(*[F.lit(f) for f in FIELDS])
    missing = lambda f: F.array(F.concat(F.lit("REQUIRED_FIELD_MISSING:"), f))
    own = lambda f: F.flatten(F.transform(F.filter("_listed", lambda x: x["field"] == f), lambda x: F.transform(x["reasons"], lambda r: F.concat(f, F.lit(":"), r))))
    given = F.flatten(F.transform(wanted, lambda f: F.when(F.exists("_listed", lambda x: x["field"] == f), own(f)).when(f.isin(REQUIRED), missing(f)).otherwise(F.array().cast(NO_TEXTS))))
    others = [c for c in g.columns if c not in ("document_id", "_listed")]
    return g.select("document_id", *others, F.transform("_listed", lambda x: x.dropFields("_place")).alias("fields"), given.alias("field_reasons"))


def normalise(inputs: DataFrame, lines: DataFrame, pages: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """One row per document of inputs: status, review, reasons, errors, fields and line items, each with its evidence.

    inputs: document_id, ocr_status and fault (null where the recognised document is the one asked for); pages:
    document_id, page, reasons; items: table_items' rows (by default those of the lines). Reasons in order: fields
    (missing ones by name), the status that recognition left, its pages, no line items, lines. A document with a fault
    is FAILED and holds nothing; one without any line lacks every required field.
    """
    held = _field_reasons(fields(lines))
    items = table_items(lines) if items is None else items
    currency = F.try_element_at(F.filter("fields", lambda x: x["field"] == "CURRENCY")["value"], F.lit(1))
    numbered = items.withColumn("line_number", (F.col("row") + 1).cast("int"))  # its row on the page, as the reasons name it
    listed = numbered.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", F.struct(*ITEM).alias("item")))).alias("_items"))
    out = inputs.join(held, "document_id", "left").join(listed, "document_id", "left")
    if pages is not None:
        said = F.explode_outer(F.col("reasons"))
        flagged = pages.select("document_id", "page", said.alias("_said")).filter("_said is not null").groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("page", "_said"))).alias("_flags"))
        out = out.join(flagged.select("document_id", F.transform("_flags", lambda x: F.concat(F.lit("OCR_PAGE_"), x["page"].cast("string"), F.lit(":"), x["_said"])).alias("_pages")), "document_id", "left")
    none = F.array().cast(NO_TEXTS)
    ocr = F.when(F.col("ocr_status") != "SUCCEEDED", F.array(F.concat(F.lit("INHERITED_OCR_STATUS:"), F.col("ocr_status")))).otherwise(none)
    every = F.array(*[F.lit(f"REQUIRED_FIELD_MISSING:{f}") for f in REQUIRED])
    by_line = F.flatten(F.transform("_items", lambda x: F.transform(x["item"]["reasons"], lambda r: F.concat(F.lit("LINE_"), x["item"]["line_number"].cast("string"), F.lit(":"), r))))
    of_lines = F.when(F.size(F.coalesce(F.col("_items"), F.array())) == 0, F.array(F.lit("NO_LINE_ITEMS_EXTRACTED"))).otherwise(by_line)
    of_pages = F.coalesce("_pages", none) if pages is not None else none
    reasons = F.array_distinct(F.concat(F.coalesce("field_reasons", every), ocr, of_pages, of_lines))
    failed = F.col("fault").isNotNull()
    reasons = F.when(failed, F.array(F.lit("NORMALIZATION_FAILED"))).otherwise(reasons)
    status = F.when(failed, "FAILED").when(F.size("reasons") > 0, "REVIEW_REQUIRED").otherwise("SUCCEEDED")
    lines_of = F.transform("_items", lambda x: x["item"].withField("currency", F.col("_currency")))
    done = out.withColumn("reasons", reasons).withColumn("_currency", currency)
    return done.select(
        "document_id", status.alias("status"), (F.size("reasons") > 0).alias("review"), "reasons", F.when(failed, F.array("fault")).otherwise(none).alias("errors"),
        F.when(~failed, F.col("fields")).alias("fields"), F.when(~failed, lines_of).alias("line_items"),
    )


def documents(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per document with lines: a column and a presence flag for each field, review and reasons (fields in their order, then pages)."""
    wide = [F.max(F.when(F.col("field") == n, F.col("value"))).alias(n.lower()) for n in FIELDS]
    kept = [n.lower() for n in FIELDS]
    out = _field_reasons(fields(lines, every=True), *wide).drop("fields")
    none = F.array().cast(NO_TEXTS)
    inherited = none
    if pages is not None:
        flagged = pages.filter("status <> 'SUCCEEDED'").groupBy("document_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("OCR_PAGE_"), F.col("page").cast("string")))).alias("_pages"))
        out, inherited = out.join(flagged, "document_id", "left"), F.coalesce("_pages", none)
    every = F.array(*[F.lit(f"REQUIRED_FIELD_MISSING:{f}") for f in REQUIRED])
    reasons = F.array_distinct(F.concat(F.coalesce("field_reasons", every), inherited))
    return out.select("document_id", *kept, *[F.col(c).isNotNull().alias(f"{c}_present") for c in kept], (F.size(reasons) > 0).alias("review"), reasons.alias("reasons"))


def combined_confidence(references: DataFrame, keys: list[str]) -> DataFrame:
    """keys with confidence: the mean over distinct references, from 0 to 100, two places."""
    mean = F.avg("confidence")
    return references.dropDuplicates([*keys, "reference_id"]).groupBy(*keys).agg(F.round(F.least(F.greatest(F.coalesce(mean, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)), 2).alias("confidence"))


def page_rollup(pages: DataFrame) -> DataFrame:
    """pages (document_id, page, status, engine) by document: FAILED with no page left, REVIEW_REQUIRED with any under review or failed, and the engines."""
    g = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_pages"), F.count_if(F.col("status") == "FAILED").alias("failed_pages"), F.concat(F.lit("phase-3:"), F.array_join(F.sort_array(F.collect_set("engine")), ",")).alias("engines"))
    status = F.when(F.col("failed_pages") == F.col("pages"), "FAILED").when(F.col("failed_pages") + F.col("review_pages") > 0, "REVIEW_REQUIRED").otherwise("SUCCEEDED")
    return g.withColumn("status", status)


# Headers of a line table's columns, and the keys of lines that end it.
COLUMNS = {"DESCRIPTION": ["DESCRIPTION", "ITEM", "ITEMS"], "QUANTITY": ["QUANTITY", "QTY"], "UNIT_PRICE": ["UNIT PRICE", "RATE", "PRICE"], "AMOUNT": ["AMOUNT", "LINE TOTAL", "TOTAL"]}
TABLE_ENDS = ["SUBTOTAL", "SUB TOTAL", "NET TOTAL", "GRAND TOTAL", "AMOUNT DUE", "BALANCE DUE"]


def table_headers(lines: DataFrame) -> DataFrame:
    """(document_id, page, col, line_order, x, bottom): each page's best row of headers, three columns at least.

    Around each description header the nearest header of every other column, within twice the larger height, counts;
    more columns win, then DESCRIPTION before ITEM, then the smaller sum of distances, then reading order.
    """
    aliases = lines.sparkSession.createDataFrame([(c, "".join(x for x in a if x.isalnum())) for c, names in COLUMNS.items() for a in names], "col string, key string")
    named = kept(lines.withColumn("key", comparison_key(F.col("text"))).join(F.broadcast(aliases), "key"))  # few of the lines, read four times
    heads = named.filter("col = 'DESCRIPTION'").select(*L.PAGE, F.col("line_order").alias("_d"), F.col("y").alias("_y"), F.col("h").alias("_h"), F.when(F.col("key") == "DESCRIPTION", 0).otherwise(1).alias("_p"))
    gap = F.abs(F.col("y") + F.col("h") / 2 - F.col("_y") - F.col("_h") / 2)
    close = named.filter("col <> 'DESCRIPTION'").join(heads, L.PAGE).withColumn("_gap", gap).filter(F.col("_gap") <= 2 * F.greatest("_h", "h", F.lit(25)))
    nearest = close.withColumn("_r", F.row_number().over(Window.partitionBy(*L.PAGE, "_d", "col").orderBy("_gap", "line_order"))).filter("_r = 1")
    rows = nearest.groupBy(*L.PAGE, "_d", "_p").agg(F.count("*").alias("_n"), F.sum("_gap").alias("_sum"))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*L.PAGE).orderBy(F.desc("_n"), "_p", "_sum", "_d"))).filter("_r = 1 and _n >= 2").select(*L.PAGE, "_d")
    place = [*L.PAGE, "col", "line_order", "x", "bottom"]
    own = named.filter("col = 'DESCRIPTION'").join(best, [*L.PAGE]).filter(F.col("line_order") == F.col("_d")).select(*place)
    return own.union(nearest.join(best, [*L.PAGE, "_d"]).select(*place))


def table_items(lines: DataFrame, most: int = 500) -> DataFrame:
    """Line items between a page's table headers and its first end marker (or the page's bottom): one typed row for each row of boxes."""
    key = comparison_key(F.col("text"))
    ends = key.rlike("|".join("".join(x for x in m if x.isalnum()) for m in TABLE_ENDS))
    heads = table_headers(lines)
    below = lines.join(heads.groupBy(*L.PAGE).agg(F.max("bottom").alias("_top")), L.PAGE)
    page = Window.partitionBy(*L.PAGE)
    below = below.withColumn("_end", F.coalesce(F.min(F.when(ends & (F.col("y") > F.col("_top")), F.col("y"))).over(page), F.max("bottom").over(page)))
    centre = F.col("y") + F.col("h") / 2
    body = below.filter((centre > F.col("_top")) & (centre < F.col("_end")) & (key != "") & ~ends)
    rows = L.row_clusters(body.withColumn("box_id", F.col("line_order").cast("long"))).withColumnRenamed("box_id", "line_order")
    boxed = L.with_references(body.join(rows, [*L.PAGE, "line_order"]))
    whole = boxed.groupBy(*L.PAGE, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_order", "reference_id"))), lambda x: x["reference_id"]).alias("evidence"), joint_confidence(F.collect_list("confidence")).alias("confidence"))
    cells = L.assign_columns(boxed.select(*L.PAGE, "row", "line_order", "x", "text", "confidence"), heads.select(*L.PAGE, "col", F.col("x").alias("hx")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "line_order", "text"))), lambda t: t["text"]), " ")
    joined = cells.groupBy(*L.PAGE, "row", "col").agg(text.alias("text"), F.round(F.avg("confidence"), 2).alias("confidence"))
    return line_items(joined, most).join(whole, [*L.PAGE, "row"])


def line_items(cells: DataFrame, most: int = 500) -> DataFrame:
    """cells (document_id, page, row, col, text, confidence) with two or more values as typed line items, numbered in their document.

    A document keeps its first most items; where it has more, truncated says so on each.
    """
    cell = {c: F.max(F.when(F.col("col") == c, F.col("text"))) for c in COLUMNS}
    wide = cells.groupBy("document_id", "page", "row").agg(*[v.alias(f"_{c}") for c, v in cell.items()], F.min("confidence").alias("_least"))
    given = lambda read, c: F.when(F.col(c).isNotNull(), read(F.col(c)))  # noqa: E731 - what is absent needs no reading
    description = lambda c: F.nullif(clean_text(c), F.lit(""))
    values = {"description": given(description, "_DESCRIPTION"), "quantity": given(parse_decimal, "_QUANTITY").cast("decimal(18,4)"), "unit_price": given(money, "_UNIT_PRICE"), "amount": given(money, "_AMOUNT")}
    wide = wide.filter(sum(F.col(f"_{c}").isNotNull().cast("int") for c in COLUMNS) >= 2)
    typed = wide.select("document_id", "page", "row", "_least", *[v.alias(n) for n, v in values.items()])
    filled = sum(F.col(c).isNotNull().cast("int") for c in values)
    reasons = F.array_compact(F.array(F.when(F.col("description").isNull(), "LINE_DESCRIPTION_MISSING"), F.when(F.col("quantity").isNull(), "LINE_QUANTITY_MISSING"), F.when(F.col("unit_price").isNull() & F.col("amount").isNull(), "LINE_FINANCIAL_VALUE_MISSING"), F.when(F.col("_least") < 70, "LOW_FIELD_CONFIDENCE")))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "row"))
    count = F.count("*").over(Window.partitionBy("document_id"))
    numbered = typed.filter(filled >= 2).withColumn("reasons", reasons).withColumn("line_number", number).withColumn("truncated", count > most)
    return numbered.filter(F.col("line_number") <= most).drop("_least")
