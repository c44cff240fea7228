"""Strict payloads, records, sinks that insert once, claims that expire."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

from tallybook.operators import audit as A
from tallybook.operators import hydration as H
from tallybook.streaming import jobs as J

SCHEMA = StructType([StructField("n", LongType(), False), StructField("x", DoubleType(), True, {"optional": True}), StructField("b", BooleanType(), True), StructField("in", StructType([StructField("d", DecimalType(18, 2)), StructField("t", ArrayType(StringType(), False))]))])


def test_strict_payloads(spark):
    good = {"n": 1, "b": None, "in": {"d": "1.50", "t": ["a"]}}
    cases = {
        json.dumps(good): [], json.dumps(good | {"x": 2}): [], json.dumps(good | {"in": None}): [],
        json.dumps(good | {"n": True}): ["/n:NOT_AN_INTEGER"], json.dumps(good | {"n": None}): ["/n:NULL_VALUE"], json.dumps(good | {"b": 1, "z": 1, "y": 1}): ["/y:UNKNOWN_KEY", "/z:UNKNOWN_KEY", "/b:NOT_A_BOOLEAN"],
        json.dumps({"n": 1, "in": {"d": 1.5, "t": ["a", 2, None]}}): ["/b:MISSING_KEY", "/in/d:NOT_A_TEXT", "/in/t/1:NOT_A_TEXT", "/in/t/2:NULL_VALUE"],
        json.dumps(good | {"in": {"d": "01.5", "t": "a"}}): ["/in/d:DECIMAL_MALFORMED", "/in/t:NOT_A_LIST"], "[1]": [":NOT_AN_OBJECT"], "{": [":NOT_JSON"], json.dumps(good) + "}": [":NOT_JSON"], "1, 2": [":NOT_JSON"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "i int, p string")
    got = {r.i: r for r in H.hydrated(rows, "p", SCHEMA).collect()}
    assert [got[i].faults for i in range(len(cases))] == list(cases.values()) and got[99].faults == [":NOT_JSON"]
    assert str(got[0].value["in"].d) == "1.50" and all((got[i].value is None) == bool(f) for i, f in enumerate(cases.values()))


def test_records_tell_changed_payloads(spark):
    results = spark.createDataFrame([("t", "a", "REVIEW_REQUIRED", None), ("t", "b", "SUCCEEDED", [])], "tenant_id string, document_id string, status string, review_reasons array<string>")
    one = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "document_id string, v double")
    payloads = dict.fromkeys(A.PAYLOADS, one.withColumn("v", F.col("v").cast("decimal(10,2)"))) | {"reference": one.filter("document_id = 'a'")}
    records = A.memory_records(results, payloads, A.uuid.UUID(int=7))
    got = {r.document_id: r for r in records.collect()}
    assert got["a"].review_reasons == ["INHERITED_REVIEW_REQUIRED"] and got["a"].normalized_payload == '{"v":"1.50"}' and got["b"].reference_payload is None
    schemas = {n: A.json_safe(p.drop("document_id")).schema for n, p in payloads.items()}
    again = A.checked(spark.createDataFrame(records.rdd, records.schema), schemas)
    assert not again.filter("altered").count() and "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert A.altered(records, schemas).count() == 0
    changed = records.withColumn("financial_payload", F.when(F.col("document_id") == "b", F.lit('{"v":"9.50"}')).otherwise(F.col("financial_payload")))
    assert [r.document_id for r in A.altered(changed, schemas).collect()] == ["b"]


def test_tenant_tables_open_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 3}", i) for i in range(30)], "tenant_id string, n int")
    A.write_by_tenant(rows, f"{tmp_path}/t")
    one = A.read_tenant(spark, f"{tmp_path}/t", "t1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and sorted(r.n for r in one.collect()) == list(range(1, 30, 3))


def test_a_repeated_batch_inserts_nothing_twice(spark, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(rows, "k string, d string, o int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, d string, o int").parquet(f"{tmp_path}/in")
        J.insert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "k", "d", "o", buckets=4)

    arrive(("a", "1", 1), ("a", "1", 2), ("a", "2", 3), ("b", None, 4))
    arrive(("a", "1", 5), ("b", "x", 6), ("b", None, 7), ("c", "1", 8))
    want = {1: "NEW", 2: "SAME", 3: "COLLISION", 4: "NEW", 5: "SAME", 6: "COLLISION", 7: "SAME", 8: "NEW"}
    read = lambda: {r.o: r.outcome for r in spark.read.parquet(f"{tmp_path}/out/outcomes").collect()}
    assert read() == want
    (tmp_path / "checkpoint" / "commits" / "1").unlink()  # as if the second batch had been cut off
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    arrive(("d", "1", 9))
    assert read() == want | {9: "NEW"} and spark.read.parquet(f"{tmp_path}/out/rows").count() == 4


def test_claims_expire(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(1, "CLAIMED", at(8, 0)), (1, "RELEASED", at(8, 20)), (2, "CLAIMED", at(8, 0)), (3, "CLAIMED", at(8, 0)), (3, "RELEASED", at(9, 0)), (4, "CLAIMED", at(9, 50)), (5, "RELEASED", at(10, 0))]
    spark.createDataFrame(rows, "case_id long, status string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    J.drain(J.claim_timeouts(J.stream_of(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").select("case_id", F.date_format("expired_at", "HH:mm").alias("t")).collect()
    assert {(r.case_id, r.t) for r in got} == {(2, "08:30"), (3, "08:30")} and len(got) == 2


def test_claims_of_one_second_follow_the_given_order(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(1, "RELEASED", at(8, 0), 9), (1, "CLAIMED", at(8, 0), 8), (2, "CLAIMED", at(8, 0), 9), (2, "RELEASED", at(8, 0), 8), (3, "CLAIMED", at(9, 30), 1), (4, "CLAIMED", at(9, 31), 1), (5, "RELEASED", at(10, 0), 1)]
    spark.createDataFrame(rows, "case_id long, status string, at timestamp, event_id long").coalesce(1).write.parquet(f"{tmp_path}/in")
    J.drain(J.claim_timeouts(J.stream_of(spark, f"{tmp_path}/in"), order="event_id"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").select("case_id", F.date_format("expired_at", "HH:mm").alias("t")).collect()
    assert sorted((r.case_id, r.t) for r in got) == [(2, "08:30"), (3, "10:00")]  # the last claim ends as the latest event comes


def test_cases_do_not_copy_the_trail_of_their_workflow(spark):
    cases = spark.createDataFrame([(k, k % 2) for k in range(6)], "case_id long, workflow_id long")
    workflows = spark.createDataFrame([(0, "A"), (1, "B")], "workflow_id long, current_status string")
    memory = cases.select("case_id", F.lit(1.0).alias("total"))
    events = spark.createDataFrame([(0, s, s, -s, "x" * s) for s in (3, 1, 2)], "workflow_id long, sequence_number int, occurred_at int, event_id long, kind string")
    decisions = spark.createDataFrame([(0, 2, 7), (0, 1, 8)], "case_id long, decided_at int, decision_id long")
    out = A.case_details(cases, workflows, memory, events, decisions)
    got = {r.case_id: r for r in out.collect()}
    assert len(got) == 6 and (got[2].n_events, got[2].first_event.event_id, got[2].last_event.kind) == (3, -1, "xxx") and got[1].n_events is None and [d.decision_id for d in got[0].decisions] == [8, 7]
    assert not any("audit_events" in c for c in out.columns)
    assert [(r.place, r.event_id) for r in A.audit_trail(cases, events).orderBy("place").collect()] == [(1, -1), (2, -2), (3, -3)]


def test_operands_are_written_behind_the_joins(spark):
    from tallybook.operators import validation as C

    cols = "document_id long, currency string, subtotal decimal(18,2), tax decimal(18,2), discount decimal(18,2), shipping decimal(18,2), total decimal(18,2), invoice_date date, due_date date"
    invoices = spark.createDataFrame([(1, "USD", None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, None)], cols)
    lines = spark.createDataFrame([(1, 1, None, None, None), (1, 2, None, None, None)], "document_id long, line_number int, quantity decimal(18,4), unit_price decimal(18,2), amount decimal(18,2)")
    kinds = [(d, c, "invoice", "PASSED") for d in (1, 2) for c in C.ORDER if c != "LINE_ITEM_ARITHMETIC"] + [(1, "LINE_ITEM_ARITHMETIC", "line-2", "SKIPPED"), (2, "LINE_ITEM_ARITHMETIC", "no-line-items", "NOT_APPLICABLE"), (1, "OTHER", "invoice", "PASSED")]
    checks = spark.createDataFrame(kinds, "document_id long, check_type string, scope string, status string")
    out = A.with_operands(checks, invoices, lines, A.uuid.UUID(int=7))
    got = {(r.document_id, r.check_type): [o.name for o in r.operands] for r in out.collect()}
    assert len(got) == len(kinds) and got[1, "LINE_ITEM_ARITHMETIC"] == ["quantity", "unit_price", "amount"] and got[2, "LINE_ITEM_ARITHMETIC"] == [] == got[1, "OTHER"]
    assert got[1, "LINE_ITEMS_TO_SUBTOTAL"] == ["line_1_amount", "line_2_amount", "subtotal"] and got[2, "LINE_ITEMS_TO_SUBTOTAL"] == ["subtotal"] and got[1, "MONETARY_VALUE_VALIDITY"] == []
    shuffled = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(shuffled) == 4  # a line's check reads its line, the sums read headers and lines, the others headers alone


def test_written_orders_shuffle_their_lines_once(spark, sf, monkeypatch):
    from tallybook.plans import coverage
    from tallybook.sources import reference as S

    plans, write = [], S.write_json_lines
    monkeypatch.setattr(S, "write_json_lines", lambda rows, path: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, path)))
    at = coverage._written(spark, sf)
    assert plans[0].count("Exchange hashpartitioning") == 3 and "BroadcastExchange" not in plans[0]  # lines, their totals, orders
    assert all(f.endswith(".json.gz") for f in os.listdir(f"{at}/orders") if f.startswith("part-"))


def test_reference_orders_keep_repeated_orders_and_lines_without_a_price(spark, sf, tmp_path):
    import duckdb

    from tallybook.plans import coverage

    con = duckdb.connect()
    con.sql(f"copy (select * from '{sf}/orders.parquet' where o_orderkey < 40 union all select * from '{sf}/orders.parquet' where o_orderkey = 7) to '{tmp_path}/orders.parquet'")
    con.sql(f"copy (select * replace (case when l_orderkey = 9 or l_linenumber = 2 then null else l_extendedprice end as l_extendedprice) from '{sf}/lineitem.parquet' where l_orderkey < 45) to '{tmp_path}/lineitem.parquet'")
    for name in ("orders", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    rows = coverage.reference_orders(spark, str(tmp_path)).select("purchase_order_number", "total_amount", "state", "n").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(con.sql(f"select purchase_order_number, total_amount, state, n from ({coverage.ORACLES['reference_orders']})").fetchall(), key=str)


def test_case_details_hold_every_decision_and_event(spark, sf):
    from tallybook.plans import audit

    e = spark.read.parquet(f"{sf}/events.parquet")
    out = audit.QUERIES["case_details"](spark, sf)
    cases = {r.case_id: r.workflow_id for r in out.filter("kind = 'CASE'").collect()}
    events = {(r.workflow_id, r.id) for r in out.filter("kind = 'EVENT'").collect()}
    assert events == {(r.user_id % 9, r.event_id) for r in e.collect() if r.user_id % 9 in set(cases.values())}
    assert {r.id for r in out.filter("kind = 'DECISION'").collect()} == {r.event_id for r in e.filter("event_type = 'click'").collect() if r.user_id in cases}
