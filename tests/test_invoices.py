"""Known invoices: checks, assignment and overlays with their expected outcomes."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.operators import layout as L
from tallybook.operators import matching as M
from tallybook.operators import review as R
from tallybook.operators import store as S
from tallybook.operators import validation as C

INVOICE = "document_id string, currency string, subtotal decimal(18,2), tax decimal(18,2), discount decimal(18,2), shipping decimal(18,2), total decimal(18,2), invoice_date date, invoice_date_present boolean, due_date date, due_date_present boolean, signals array<string>, inherited_review boolean"
LINE = "document_id string, line_number int, quantity decimal(18,4), unit_price decimal(18,2), amount decimal(18,2)"


def D(x):
    return None if x is None else Decimal(x)


def tables(spark):
    rows = [
        ("T", "EUR", D("858.86"), D("36.45"), D("-12.54"), None, D("873.58"), date(2000, 4, 12), True, date(1998, 3, 15), True, ["EUR", "USD"], True),
        ("F", "USD", D("63.45"), D("5.77"), None, None, D("69.22"), date(2002, 6, 28), True, None, False, ["USD"], False),
        ("P", "USD", D("48.71"), None, D("9.74"), D("11.13"), D("50.10"), date(2012, 3, 6), True, None, False, ["USD"], True),
        ("W", None, D("63.45"), D("5.77"), None, None, None, date(2002, 6, 28), True, None, False, [], True),
        ("E", None, None, None, None, None, None, None, False, None, False, None, None),
    ]
    five = [("10", "0.65", "6.50"), ("4", "0.85", "3.40"), ("2", "4.15", "8.30"), ("10", "2.46", "24.60"), ("7", "2.95", "20.65")]
    lines = [(d, i + 1, D(q), D(p), D(a)) for d in "FW" for i, (q, p, a) in enumerate(five)]
    lines += [("P", 1, D("1"), D("48.71"), D("48.71"))] + [("T", i, D("1"), D("2"), None) for i in range(1, 6)]
    return spark.createDataFrame(rows, INVOICE), spark.createDataFrame(lines, LINE)


def test_checks_of_known_invoices(spark):
    invoices, lines = tables(spark)
    checks = C.all_checks(invoices, lines)
    got = {r.document_id: (r.performed, r.passed, r.failed, r.review_required, r.not_applicable, r.skipped, r.overall) for r in C.summarise(checks).collect()}
    assert got["T"] == (12, 2, 3, 1, 0, 6, "REVIEW_REQUIRED")
    assert got["F"] == (12, 11, 0, 0, 1, 0, "SUCCEEDED")
    assert got["P"] == (8, 6, 0, 1, 1, 0, "REVIEW_REQUIRED")
    assert got["W"] == (12, 7, 0, 4, 1, 0, "REVIEW_REQUIRED")
    total = {r.document_id: (r.status, r.expected, r.difference) for r in checks.filter("check_type = 'INVOICE_TOTAL_RECONCILIATION'").collect()}
    assert total["T"] == ("FAILED", D("882.77"), D("-9.19"))
    assert total["W"] == ("REVIEW_REQUIRED", D("69.22"), None)
    assert total["E"][0] == "SKIPPED"
    reasons = {r.document_id: r.reasons for r in C.review_reasons(checks).collect()}
    assert reasons["W"][-2:] == ["TOTAL_AMOUNT_MISSING", "CALCULATED_TOTAL_NOT_PERSISTED"]


def test_empty_tables(spark):
    invoices, lines = tables(spark)
    assert C.all_checks(invoices.limit(0), lines.limit(0)).count() == 0


def test_greedy_assignment(spark):
    rows = [("d", 1, 1, 0.8), ("d", 1, 2, 0.9), ("d", 2, 1, 0.1), ("d", 2, 2, 0.95), ("d", 3, 1, 0.2), ("d", 3, 2, 0.2), ("e", 1, None, None)]
    pairs = spark.createDataFrame(rows, "document_id string, line_number int, po_line_number int, score double")
    got = {(r.document_id, r.line_number): (r.po_line_number, r.method) for r in M.assign_lines(pairs).collect()}
    assert got == {("d", 1): (2, "DESCRIPTION"), ("d", 2): (None, "NONE"), ("d", 3): (None, "NONE"), ("e", 1): (None, "NONE")}


def test_suppliers(spark):
    s = spark.createDataFrame([("SUP-001", "Snyder, Hammond and Anderson", ["Snyder Hammond & Anderson"], True, True), ("SUP-003", "SuperStore", ["Super Store"], True, True), ("SUP-004", "Legacy Office Supplies", None, False, False)], "supplier_id string, legal_name string, aliases array<string>, active boolean, approved boolean")
    inv = spark.createDataFrame([("a", "SNYDER HAMMOND AND ANDERSON"), ("b", "Super Stor"), ("c", "Legacy Office Supplies"), ("d", None), ("e", "zzz"), ("f", "...")], "document_id string, supplier_name string")
    got = {r.document_id: (r.supplier_status, r.supplier_id, r.supplier_reason) for r in M.resolve_suppliers(inv, s).collect()}
    assert got["a"] == ("MATCHED", "SUP-001", None)
    assert got["b"] == ("MATCHED", "SUP-003", None)
    assert got["c"] == ("CONFLICT", "SUP-004", "SUPPLIER_INACTIVE")
    assert got["d"][2] == "SUPPLIER_NAME_MISSING" and got["e"][0] == "NOT_FOUND" and got["f"][0] == "NOT_FOUND"


def test_overlay_and_restart(spark):
    f = spark.createDataFrame([("d", "A", "1"), ("d", "B", None)], "document_id string, field_name string, value string")
    c = spark.createDataFrame([("d", "A", "9", "2"), ("d", "B", None, "3"), ("d", "C", None, "4"), ("d", "C", None, "5")], "document_id string, field_name string, previous string, corrected string")
    got = {r.field_name: (r.value, r.error) for r in R.overlay(f, c).collect()}
    assert got == {"A": ("1", "PREVIOUS_VALUE_MISMATCH"), "B": ("3", None), "C": (None, "DUPLICATE_TARGET")}
    rows = spark.createDataFrame([("APPROVED", []), ("CORRECTED", ["SUPPLIER_NAME"]), ("CORRECTED", []), ("HOLD", ["TAX_AMOUNT"])], "d string, f array<string>")
    assert [r.s for r in rows.select(R.restart_stage(F.col("d"), F.col("f")).alias("s")).collect()] == ["MEMORY_PERSISTENCE", "REFERENCE_MATCHING", None, None]


def test_row_clusters_follow_the_running_mean(spark):
    rows = [("d", 1, 0, 0, 20, 1), ("d", 1, 50, 10, 20, 2), ("d", 1, 90, 16, 20, 3), ("d", 1, 0, 60, 20, 4)]
    boxes = spark.createDataFrame(rows, "document_id string, page int, x int, y int, h int, box_id long")
    got = sorted((r.row, r.box_id) for r in L.row_clusters(boxes).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_insert_if_absent_and_manifest(spark):
    held = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None)], "k string, h string")
    assert {r.k: r.outcome for r in S.insert_if_absent(held, new, "k", "h").collect()} == {"a": "SAME", "b": "COLLISION", "c": "NEW"}
    m = S.manifest(new.filter("h is not null"), "k", "h")
    assert S.verify_manifest(m, m, "k").count() == 0
