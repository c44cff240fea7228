"""Functions on single values, at the edges of their rules."""

import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import text as T
from tallybook.functions import values as V
from tallybook.operators import workflow as W


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


MONEY = [("Total: $1,234.50", "1234.50"), ("1.234,56", "1234.56"), ("VAT 4.24% 36.45", "36.45"), ("(12.54)", "-12.54"), ("(-) $ 5", "-5.00"), ("-3.005", "-3.01"), ("1,50", "1.50"), ("1,500", "1500.00"), ("1.234.567", "1234567.00"), ("no amount", None), ("", None), (None, None), ("8%", None), ("€ 9.745", "9.75")]


@pytest.mark.parametrize("raw, want", MONEY)
def test_money(spark, raw, want):
    assert one(spark, V.money(F.lit(raw).cast("string"))) == (None if want is None else Decimal(want))


@pytest.mark.parametrize("raw, want", [("2012-03-06", date(2012, 3, 6)), ("06-Mar-2012", date(2012, 3, 6)), ("MARCH 6, 2012", date(2012, 3, 6)), ("Due Date: 2012.3.6", date(2012, 3, 6)), ("03/06/2012", None), ("13/06/2012", date(2012, 6, 13)), ("06/13/2012", date(2012, 6, 13)), ("31/02/2012", None), ("soon", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, V.parse_date(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("USD 5", "USD"), ("AUSD", None), ("US$5", "USD"), ("RMB", "CNY"), ("€5", "EUR"), ("", None)])
def test_currency(spark, raw, want):
    assert one(spark, V.currency_code(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("Invoice No: inv-1001", "INV-1001"), ("#ab1", "AB1"), ("Invoice Date: 2012-01-01", None), ("12.50", None), ("ABC", None), ("2012-01-01", None), ("A 1/7", "A1/7")])
def test_invoice_number(spark, raw, want):
    assert one(spark, V.invoice_number(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("PO-000123", "000123"), ("P.O. No.: 99", "99"), ("Purchase Order Number #CA-2012-AB", "CA2012AB"), (None, "")])
def test_reference_key(spark, raw, want):
    assert one(spark, T.reference_key(F.lit(raw).cast("string"))) == want


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    for name in ("", "a|b", "ü"):
        assert one(spark, T.uuid5(space, F.lit(name))) == str(uuid.uuid5(space, name))


def test_keys_fold_accents_and_white_space(spark):
    assert one(spark, T.business_key(F.lit("Café  Müller & Co."))) == "CAFE MULLER CO"
    assert one(spark, T.clean_text(F.lit(" ﬁne  print "))) == "fine print"


def test_failure_classes(spark):
    cases = {("ArtifactCollisionError", ""): "INTEGRITY", ("ApprovalError", ""): "POLICY", ("X", "relation does not exist"): "PERMANENT", ("AssertionError", ""): "INTEGRITY", ("ValueError", "timeout"): "PERMANENT", ("X", "Rate limit hit"): "TRANSIENT", ("X", ""): "UNKNOWN"}
    for (name, message), want in cases.items():
        assert one(spark, W.failure_class(F.lit(name), F.lit(message))) == want


@pytest.mark.parametrize("attempt, want", [(1, 0.0), (2, 1.0), (3, 2.0), (9, 8.0)])
def test_retry_delay(spark, attempt, want):
    assert one(spark, V.retry_delay(F.lit(attempt))) == want


def test_comparison_key_covers_all_texts(spark, tmp_path):
    import hashlib
    import re

    from tallybook.plans import finance

    texts = ["Rue de l'Été 12", "Straße Köln", "ﬁn ſ ı", "año nuevo", "plain 7", "日本", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: hashlib.md5(re.sub("[^A-Z0-9]", "", (t or "").upper()).encode()).hexdigest() for i, t in enumerate(texts)}
    got = {r.doc_id: r.key_md5 for r in finance.QUERIES["fn_comparison_key"](spark, str(tmp_path)).collect()}
    assert got == want
