"""Grown rows stay within a task: how many documents one task holds, and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from tallybook.operators import extract as X
from tallybook.plans import coverage, more, records


@pytest.mark.parametrize("rows", [records._lines, records._tokens])
def test_lines_and_words_are_dealt_by_document_before_they_are_written(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(records, "INVOICES", 10, raising=False)
    held = rows(spark, sf).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("document_id").alias("n")).collect()
    assert max(r.n for r in held) <= 30


@pytest.mark.parametrize("name", ["token_lines", "combined_confidence", "evidence_audit"])
def test_words_are_not_shuffled(spark, sf, name):
    plan = {**records.QUERIES, **coverage.QUERIES}[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    grown = plan[: plan.index("Generate")]
    assert "Exchange" not in grown, grown


def test_absent_cells_of_line_items_are_not_read(spark, sf):
    plan = more.QUERIES["line_items"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert any("isnotnull(_QUANTITY" in x and "Filter" in x for x in plan.splitlines())
    cells = spark.createDataFrame([("a", 1, 1, "DESCRIPTION", "x", 90.0), ("a", 1, 1, "AMOUNT", "2", 90.0), ("a", 1, 2, "AMOUNT", "3", 90.0), ("a", 1, 3, "DESCRIPTION", " ", 90.0), ("a", 1, 3, "QUANTITY", "no", 90.0)], "document_id string, page int, row int, col string, text string, confidence double")
    assert [(r.row, r.line_number, str(r.amount), r.quantity) for r in X.line_items(cells).collect()] == [(1, 1, "2.00", None)]


@pytest.mark.parametrize("name", ["extracted_fields", "extracted_review", "field_candidates", "field_evidence", "spatial_values", "values_below"])
def test_lines_of_a_page_are_neither_joined_nor_shuffled(spark, sf, name):
    from tallybook.plans import pages

    plan = pages.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    behind = plan[: plan.index("REPARTITION_BY_NUM")]  # what comes after invoices are dealt to tasks
    assert behind.count("Exchange") == 1 and "Join" not in behind and "Scan" not in behind


def test_values_are_read_the_same_by_short_ways(spark):
    from tallybook.functions import values as V

    rows = [("$873.58", "873.58"), ("873.58", "873.58"), ("$1,873.58", "1873.58"), ("(-) $5.00", "-5.00"), ("5.0", "5.00"), ("$7.00\n", "7.00")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", V.money(F.col("t")).cast("string").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    numbers = [("INV-7", "INV-7"), ("# AB 1", "AB1"), ("12/03/2024", "12/03/2024"), ("13/03/2024", None), ("2024-01-15", None), ("ab", None), ("Invoice No: x-1 2", "X-12")]
    got = spark.createDataFrame(numbers, "t string, want string").select("want", V.invoice_number(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
