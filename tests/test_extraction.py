"""Fields, parties, addresses and whole documents out of recognised lines, with what they must never infer."""

import pytest
from pyspark.sql import functions as F

from tallybook.functions.text import party_name
from tallybook.operators import extract as X
from tallybook.operators import layout as L
from tallybook.operators import matching as M

LINE = "document_id string, page int, line_order int, text string, x int, y int, w int, h int, confidence double"


def page(spark, *lines):
    """lines: (document, text, x, y, w[, h[, page]])."""
    rows = []
    for n, (d, text, x, y, w, *more) in enumerate(lines, 1):
        rows.append((d, more[1] if len(more) > 1 else 1, n, text, x, y, w, more[0] if more else 15, 90.0))
    return spark.createDataFrame(rows, LINE).withColumn("right", F.col("x") + F.col("w")).withColumn("bottom", F.col("y") + F.col("h"))


def values(spark, lines):
    return {(r.document_id, r.field): r.value for r in X.fields(lines).collect()}


def test_what_is_absent_is_never_taken_from_elsewhere(spark):
    lines = page(
        spark,
        ("a", "SUBTOTAL: 63.45", 0, 0, 150), ("a", "TAX: 5.77", 0, 40, 150),
        ("b", "Subtotal", 400, 600, 80), ("b", "$63.45", 600, 602, 80), ("b", "TOTAL", 400, 660, 60),
        ("c", "2024-01-15", 50, 100, 100), ("c", "Invoice Date", 200, 100, 120), ("c", "Due Date", 400, 100, 100), ("c", "-", 560, 100, 10),
        ("d", "Due Date", 400, 100, 100), ("d", "2024-02-15", 405, 150, 100),
        ("e", "Due Date", 400, 100, 100), ("e", "2024-02-15", 520, 128, 100),
    )
    got = values(spark, lines)
    assert got[("a", "SUBTOTAL")] == got[("b", "SUBTOTAL")] == "63.45" and ("a", "TOTAL_AMOUNT") not in got and ("b", "TOTAL_AMOUNT") not in got
    assert got[("c", "INVOICE_DATE")] == "2024-01-15" and ("c", "DUE_DATE") not in got and ("d", "DUE_DATE") not in got and got[("e", "DUE_DATE")] == "2024-02-15"
    reasons = {r.document_id: r.reasons for r in X.documents(lines).collect()}
    assert all("REQUIRED_FIELD_MISSING:TOTAL_AMOUNT" in reasons[d] for d in "abcde")


def test_the_nearest_value_to_the_labels_right_edge_wins(spark):
    lines = page(spark, ("a", "TOTAL", 400, 660, 60), ("a", "$999.00", 760, 661, 80), ("a", "$12.00", 500, 661, 80), ("a", "$7.00", 300, 660, 60))
    row = X.fields(lines).filter("field = 'TOTAL_AMOUNT'").first()
    assert row.value == "12.00" and row.evidence == ["P1-L1", "P1-L3"] and row.n_candidates == 1 and row.confidence == 91.0 and row.method == "SPATIAL_PROXIMITY"


@pytest.mark.parametrize(("text", "wanted"), [("ACME Ltd", True), ("INVOICE", False), ("TAX ID 123", False), ("Buyer Company", False), ("x@y.com", False), ("+44 (20) 123", False), ("ab", False), ("Ünïcorn", True), ("a b c d e f g h i j k", False), (None, False)])
def test_party_names(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(party_name(F.col("t"))).first()[0] == wanted


def test_header_parties_stand_above_the_customers_mark(spark):
    lines = page(
        spark,
        ("a", "INVOICE", 50, 10, 100), ("a", "Acme Ltd", 50, 40, 100), ("a", "Globex", 500, 60, 100), ("a", "foot", 50, 980, 500),
        ("b", "Bill To", 500, 40, 80), ("b", "Acme Ltd", 50, 40, 100), ("b", "foot", 50, 980, 500),
    )
    got = {(r.document_id, r.field): r.text for r in L.header_parties(lines).collect()}
    assert got == {("a", "SUPPLIER_NAME"): "Acme Ltd", ("a", "CUSTOMER_NAME"): "Globex"}


def test_values_below_leave_out_other_parts_and_empty_keys(spark):
    lines = page(spark, ("a", "Ship To", 50, 100, 80), ("a", "Bill To", 60, 120, 80), ("a", "--", 60, 130, 20), ("a", "12 Road,", 60, 140, 90), ("a", "Springfield", 60, 160, 90), ("a", "Invoice Date", 60, 180, 90), ("a", "far", 60, 900, 90), ("a", "aside", 700, 140, 90))
    address = L.combined_address(L.values_below(L.label_lines(lines).filter("field = 'CUSTOMER_ADDRESS'"), lines, top=4)).collect()
    assert [r.address for r in address] == ["12 Road, Springfield"]


def test_a_whole_document(spark):
    header = [("SUPPLIER: Acme Ltd", 0), ("INVOICE NUMBER: 1001", 40), ("INVOICE DATE: 2024-01-15", 80), ("USD", 120), ("TOTAL: 10.00", 160)]
    table = [("Description", 0, 240), ("Qty", 300, 240), ("Unit Price", 400, 240), ("Amount", 500, 240), ("Widget", 0, 280), ("1", 300, 280), ("10.00", 400, 280), ("10.00", 500, 280), ("SKU-9", -60, 320), ("Gadget", 0, 320), ("5.00", 500, 320)]
    lines = page(spark, *[("a", t, 0, y, 250) for t, y in header], *[("a", t, x, y, 60) for t, x, y in table[:8]], *[("b", t, x, y, 60) for t, x, y in table], *[("c", t, 0, y, 250) for t, y in header])
    inputs = spark.createDataFrame([("a", "SUCCEEDED", None), ("b", "REVIEW_REQUIRED", None), ("c", "SUCCEEDED", "HASH_MISMATCH"), ("d", "SUCCEEDED", None)], "document_id string, ocr_status string, fault string")
    pages = spark.createDataFrame([("b", 1, ["CRITICAL_TOTAL_VALUE_MISSING"])], "document_id string, page int, reasons array<string>")
    got = {r.document_id: r for r in X.normalise(inputs, lines, pages).collect()}
    a = got["a"]
    assert (a.status, a.reasons, [x.value for x in a.fields if x.field != "CUSTOMER_NAME"]) == ("SUCCEEDED", [], ["Acme Ltd", "1001", "2024-01-15", "USD", "10.00"])
    assert [(x.line_number, x.description, str(x.amount), x.currency, len(x.evidence)) for x in a.line_items] == [(1, "Widget", "10.00", "USD", 4)]
    b = got["b"]
    assert [x.description for x in b.line_items] == ["Widget", "Gadget"] and "LINE_2:LINE_QUANTITY_MISSING" in b.reasons
    assert b.reasons.index("INHERITED_OCR_STATUS:REVIEW_REQUIRED") + 1 == b.reasons.index("OCR_PAGE_1:CRITICAL_TOTAL_VALUE_MISSING")
    assert (got["c"].status, got["c"].errors, got["c"].fields, got["c"].reasons) == ("FAILED", ["HASH_MISMATCH"], None, ["NORMALIZATION_FAILED"])
    assert got["d"].reasons == [f"REQUIRED_FIELD_MISSING:{f}" for f in X.REQUIRED] + ["NO_LINE_ITEMS_EXTRACTED"]


def test_an_address_lifts_a_name_or_makes_it_ambiguous(spark):
    s = spark.createDataFrame(
        [("S1", "Northern Lights Paper", None, ["12 High Street, Leeds"], True, True), ("S2", "Southern Cross Foods", None, ["1 Quay"], True, True), ("S3", "Southern Cross Foodxy", None, ["9 Mill Lane"], True, True)],
        "supplier_id string, legal_name string, aliases array<string>, addresses array<string>, active boolean, approved boolean",
    )
    inv = spark.createDataFrame(
        [("lifted", "Northern Lights P", "12 High Street Leeds"), ("low", "Northern Lights P", "elsewhere"), ("bare", "Northern Lights P", None), ("one", "Southern Cross Foods", None), ("torn", "Southern Cross Foods", "9 Mill Lane")],
        "document_id string, supplier_name string, supplier_address string",
    )
    got = {r.document_id: (r.supplier_status, r.supplier_id, r.supplier_score) for r in M.resolve_suppliers(inv, s).collect()}
    assert got["lifted"] == ("MATCHED", "S1", 0.9247) and got["low"][0] == got["bare"][0] == "NOT_FOUND"
    assert got["one"] == ("MATCHED", "S2", 1.0) or got["one"][0] == "AMBIGUOUS"
    assert got["torn"][0] == "AMBIGUOUS"


def test_line_tables_work_out_orders_and_headers_once(spark, sf):
    from tallybook.operators import extract as X
    from tallybook.plans.coverage import _table_pages

    pages = _table_pages(spark, sf)
    plan = X.table_headers(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan and "regexp_replace" not in plan  # keys are made before, in one pass
    assert "Window" not in pages._jdf.queryExecution().optimizedPlan().toString()


def test_header_parties_sort_a_page_once_and_labels_need_no_patterns(spark):
    rows = [(1, 1, 1, "Acme\u00a0Stores", 50, 40, 200, 20), (1, 1, 2, "Other Works", 500, 60, 150, 20), (1, 1, 3, "Bill To", 50, 90, 80, 20), (1, 1, 4, "Late Name", 50, 120, 80, 20), (1, 1, 5, "\uff34otal  due", 50, 900, 80, 20), (2, 1, 1, "Alone", 50, 40, 60, 20)]
    lines = spark.createDataFrame(rows, "document_id long, page int, line_order int, text string, x int, y int, w int, h int")
    found = L.header_parties(lines)
    assert sorted((r.document_id, r.field, r.line_order) for r in found.collect()) == [(1, "CUSTOMER_NAME", 2), (1, "SUPPLIER_NAME", 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    labelled = L.label_lines(lines)
    assert sorted((r.line_order, r.field) for r in labelled.collect()) == [(3, "CUSTOMER_NAME"), (5, "TOTAL_AMOUNT")]
    assert "|".join(L._bare(x) for x in L.LABELS["TOTAL_AMOUNT"]) not in labelled._jdf.queryExecution().optimizedPlan().toString()
