"""Candidates and scores of names against plain Python; the library without the language-model folders."""

import difflib
import os
import random
import shutil
import subprocess
import sys
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tallybook.functions import text as T
from tallybook.operators import matching as M

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _key(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).upper().split())


def _ratio(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a == b else float(Decimal(str(difflib.SequenceMatcher(None, a, b).ratio())).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def test_supplier_scores_match_brute_force(spark):
    r = random.Random(7)
    base = ["Müller Söhne GmbH", "Acme Stores", "ACME Storès", "Łódź Trading", "ﬁne Print", "A", "Ab", "SUP-12", "SUP-123", "aaaa aaaa aaaa"] + ["".join(r.choice("abcd ") for _ in range(r.randint(1, 24))) for _ in range(40)]
    changed = []
    for b in base:
        x = list(b)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = r.choice(["", "b", "é"])
        changed.append("".join(x))
    suppliers = spark.createDataFrame([(f"S{i}", n, None, True, True) for i, n in enumerate(base)], "supplier_id string, legal_name string, aliases array<string>, active boolean, approved boolean")
    names = spark.createDataFrame([(n,) for n in {*changed, ""}], "supplier_name string")
    got = {(x.supplier_name, x.supplier_id): x.score for x in M.score_suppliers(names, suppliers).collect()}
    want = {}
    for n in set(changed):
        scored = sorted(((_ratio(_key(n), _key(b)), f"S{i}") for i, b in enumerate(base) if _key(n) and _key(b)), reverse=True)[:5]
        want |= {(n, i): s for s, i in scored if s >= 0.9}
    assert got == want


def _common(a, b):
    """The length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_candidates_are_few_and_none_is_lost(spark):
    r = random.Random(3)
    words = ["".join(r.choice("ABC ") for _ in range(r.randint(1, 28))) for _ in range(120)]
    changed = [w[:k] + r.choice(["", "A", "BB"]) + w[k + r.randint(0, 2) :] for w in words for k in [r.randrange(len(w) + 1)] for _ in range(3)]
    keys = lambda texts, name: spark.createDataFrame([(t,) for t in sorted({t for t in texts if t})], f"{name} string")
    for threshold in (0.9, 0.87, 0.75):
        got = {tuple(x) for x in M.near_keys(keys(changed, "name_key"), keys(words, "known_key"), threshold).collect()}
        assert {(a, b) for a in changed for b in words if a and b and a != b and 2 * _common(a, b) / (len(a) + len(b)) >= threshold - 1e-9} <= got
    # numbered names differ in one digit from many, but of nine letters none may differ: only a letter more or less is near
    numbers = [f"SUP {n}" for n in (*range(1000, 1100), *range(10000, 10100))]
    got = {tuple(x) for x in M.near_keys(keys(numbers, "name_key"), keys(numbers, "known_key"), 0.9).collect()}
    assert got == {(a, b) for a in numbers for b in numbers if a != b and 2 * _common(a, b) / (len(a) + len(b)) >= 0.9 - 1e-9}


def test_lines_take_the_best_free_order_line(spark):
    lines = spark.createDataFrame([(1, 1, 1, "red bolt"), (1, 1, 2, "blue nut"), (2, 2, 1, "green pipe"), (2, 2, 2, "green pipes"), (2, 2, 3, None), (3, 3, 1, "same"), (3, 3, 2, "same")], "document_id long, po_key long, line_number int, description string")
    orders = spark.createDataFrame([(1, 1, "blue nut"), (1, 2, "red bolt"), (2, 1, "green pipes"), (2, 2, "other"), (3, 4, "same"), (3, 3, "same")], "po_key long, po_line_number int, po_description string")
    got = {(x.document_id, x.line_number): (x.po_line_number, x.method) for x in M.match_lines(lines, orders).collect()}
    assert got == {(1, 1): (2, "DESCRIPTION"), (1, 2): (1, "DESCRIPTION"), (2, 1): (1, "DESCRIPTION"), (2, 2): (2, "LINE_NUMBER"), (2, 3): (None, "NONE"), (3, 1): (3, "DESCRIPTION"), (3, 2): (4, "DESCRIPTION")}


def test_unicode_keys(spark):
    texts = ["Müller & Söhne", "Ｆｕｌｌ１２３", "ﬁne oﬃce", "café", "½ №5 ™", "Ⅳ", "Ça\xa0va", "Ǆ", "İstanbul", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.business_key(F.col("t")).alias("b"), T.clean_text(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.b == _key(r.t or "") and r.c == " ".join(unicodedata.normalize("NFKC", r.t or "").split())


def test_comparison_key_of_all_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.comparison_key(F.col("text")).alias("k")).collect()
    for r in rows:
        assert r.k == "".join(c for c in unicodedata.normalize("NFKC", r.text or "").upper() if c.isascii() and c.isalnum())


def test_without_the_language_model_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=bare)
    tests = ["tests/test_queries.py::test_query[stage_routes]", "tests/test_queries.py::test_query[fn_sha256]", "tests/test_stored.py::test_tenant_tables_open_one_folder"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *tests], cwd=tmp_path / "repo", check=True, env=bare)


def test_sides_that_grow_are_not_broadcast(spark, sf):
    from tallybook.plans import finance
    from tallybook.sources.derived import derived
    from tallybook.sources.shared import kept

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    get = finance._Tables(spark, sf)
    results = get.keep("some_results", get("po").select("po_key", "state"))
    rows = kept(spark.range(9).withColumn("t", F.lit("x")))
    for df in (derived(spark, sf, "inv_lines"), derived(spark, sf, "po"), results.join(get("gr"), "po_key"), rows.join(spark.range(3), "id")):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    assert "FileScan parquet" in plan(rows) and sorted(r.id for r in rows.collect()) == list(range(9))


def test_settled_lines_carry_their_order_line_and_are_not_joined_to_it_again(spark):
    lines = spark.createDataFrame([(1, 7, 1, "Blue ring", 2), (1, 7, 2, "Hot bolt", 3), (2, 8, 1, "Blue ring", 4), (2, 8, 2, "quite other", 5), (3, 9, 1, "Nut", 6)], "document_id long, po_key long, line_number int, description string, quantity int")
    orders = spark.createDataFrame([(7, 1, "hot bolt", 30), (7, 2, "blue ring", 20), (8, 1, "blue ring", 40), (8, 2, "Nail", 50)], "po_key long, po_line_number int, po_description string, po_qty int")
    out = M.with_order_lines(lines, orders)
    got = {(r.document_id, r.line_number): (r.quantity, r.po_line_number, r.po_qty, r.method) for r in out.collect()}
    assert got == {(1, 1): (2, 2, 20, "DESCRIPTION"), (1, 2): (3, 1, 30, "DESCRIPTION"), (2, 1): (4, 1, 40, "DESCRIPTION"), (2, 2): (5, 2, 50, "LINE_NUMBER"), (3, 1): (6, None, None, "NONE")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in x for x in plan.splitlines()) == 3  # of the scored lines alone: their pairs, what they take, its order line
