import datetime as dt

from conftest import rows_of
from pyspark.sql import functions as F

from casework.operators import quality, reports

T0 = dt.datetime(2026, 1, 1)


def test_newest_rows_win_ties_by_id(spark):
    audit = spark.createDataFrame([(1, "O1", T0, "a"), (2, "O1", T0, "b"), (3, "O2", T0, "c")], "id long, target_id string, created_at timestamp, x string")
    assert rows_of(reports.latest_audit(audit), "target_id", "x") == [("O1", "b"), ("O2", "c")]
    escalations = spark.createDataFrame([(1, "T", T0, "created"), (2, "T", T0, "cancelled")], "id long, ticket_id string, created_at timestamp, status string")
    assert rows_of(reports.latest_escalation(escalations), "id") == [(2,)]
    assert rows_of(reports.latest_escalation(escalations, "created"), "id") == [(1,)]


def test_authority_prefers_rank_then_newer_effect(spark):
    day = dt.date
    docs = spark.createDataFrame(
        [("a", "p", "DEPRECATED", 1, None, None), ("b", "p", "CURRENT", 2, None, None), ("c", "p", "ACTIVE", 2, None, day(2020, 1, 1)),
         ("d", "p", "CURRENT", 2, None, day(2024, 1, 1)), ("e", "p", "CURRENT", 3, "A1", None)],
        "filename string, document_type string, status string, authority_rank int, account_id string, effective_from date"
    ).withColumn("title", F.col("filename"))
    assert rows_of(reports.authority_rank(docs), "account_id", "filename") == [("A1", "e"), (None, "d")]


def test_resolution_rate_without_eligible_requests(spark):
    rows = [("d1", None, False, False), ("d1", None, True, False), ("d1", "boom", None, None), ("d2", "boom", None, None)]
    df = spark.createDataFrame(rows, "day string, error string, escalate boolean, needs_agent boolean")
    assert rows_of(reports.resolution_rate(df, ["day"])) == [("d1", 2, 1, 0.5), ("d2", 0, 0, None)]


def test_violations(spark):
    accounts = spark.createDataFrame([("A1", "n", "Gold", "s", True), ("A1", None, "Growth", "s", True)],
                                     "account_id string, account_name string, plan string, status string, premium_support boolean")
    tickets = spark.createDataFrame([("T1", "A9", None, "s", "s", "d"), ("T2", None, T0, "s", "s", "d")],
                                    "ticket_id string, account_id string, created_at timestamp, status string, subject string, description string")
    assert rows_of(quality.violations({"accounts": accounts, "tickets": tickets})) == [
        ("accounts.account_id unique", "A1"), ("accounts.account_name not null", "A1"), ("accounts.plan allowed", "A1"),
        ("tickets.account_id not null", "T2"), ("tickets.account_id references accounts", "T1"), ("tickets.created_at not null", "T1")]


def test_active_uniqueness_and_amounts(spark):
    escalations = spark.createDataFrame([("T", "created"), ("T", "created"), ("U", "created"), ("U", "cancelled")], "ticket_id string, status string")
    credits = spark.createDataFrame([(1, "O", "ISSUED", 0.0), (2, "O", "APPROVED", 1.0), (3, "P", "REJECTED", -1.0), (4, "P", "ISSUED", 2.0)],
                                    "id long, order_id string, status string, amount_inr double")
    assert rows_of(quality.check_active_unique(escalations, credits)) == [
        ("one active credit per order", "O"), ("one created escalation per ticket", "T")]
    assert rows_of(quality.check_amount(credits), "key") == [("1",), ("3",)]


def test_foreign_keys_hold_parents_and_not_rows_in_memory(spark, settings, monkeypatch):
    monkeypatch.setattr(quality, "PARENTS", 100)
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    accounts = spark.createDataFrame([("A1",), ("A1",), ("T1",)], "account_id string")
    tickets = spark.createDataFrame(
        [(f"T{i}", "A1" if i % 10 else "T1" if i % 20 else "A2") for i in range(2000)] + [("T-", None)], "ticket_id string, account_id string")
    escalations = spark.createDataFrame([(1, "T1", "A1"), (2, "A1", "A3")], "id long, ticket_id string, account_id string")
    found = quality.check_foreign_keys({"accounts": accounts, "tickets": tickets, "escalations": escalations})
    assert rows_of(found) == sorted(
        [("tickets.account_id references accounts", f"T{i}") for i in range(0, 2000, 20)]
        + [("escalations.ticket_id references tickets", "2"), ("escalations.account_id references accounts", "2")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    assert found.rdd.getNumPartitions() == 21  # 2004 parent keys; a task holds about 100
