import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.operators import context, decide

T0 = dt.datetime(2026, 8, 16, 12)
AGREEMENT = "Harbor Freight may cancel\n any BOOKED shipment before   pickup with no cancellation fee."
OVERRIDE = "Harbor Freight gets a fixed INR 300 service credit when more than 4 hours past the end and the carrier is at fault."


def world(spark, status="BOOKED", fee=1200.0, carrier=True, customer=False, end=T0 - dt.timedelta(hours=3),
          chunks=(), tickets=(), query="q", account="A1", order="O1", name="Harbor Freight"):
    requests = spark.createDataFrame([(1, query, account, order, T0)],
                                     "request_id long, query string, account_id string, order_id string, requested_at timestamp")
    accounts = spark.createDataFrame([("A1", name, "Growth", "Active", False)],
                                     "account_id string, account_name string, plan string, status string, premium_support boolean")
    orders = spark.createDataFrame([("O1", "A1", status, "Fast", fee, carrier, customer, end, T0)],
                                   "order_id string, account_id string, status string, carrier string, shipment_fee_inr double,"
                                   "carrier_fault boolean, customer_fault boolean, pickup_window_end timestamp, booked_at timestamp")
    ticket_rows = spark.createDataFrame([(f"T{i}", "A1", T0 + dt.timedelta(minutes=i), "closed", s) for i, s in enumerate(tickets)],
                                        "ticket_id string, account_id string, created_at timestamp, status string, subject string")
    evidence = spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate(chunks)],
                                     "request_id long, document_id long, content string, score double")
    return requests, accounts, orders, ticket_rows, evidence


def evaluate(spark, **kw):
    return decide.evaluate_requests(*world(spark, **kw)).first()


def credit(spark, cap=500.0, **kw):
    return decide.service_credit_decisions(*world(spark, **kw), cap=cap).first()


def test_picked_up_order_is_returned(spark):
    d = evaluate(spark, status="PICKED_UP")
    assert (d.action.type, d.action.target, d.confidence, d.allowed) == ("RETURN_TO_ORIGIN", "O1", 1.0, False)


@pytest.mark.parametrize("status, reason", [
    ("RETURN_TO_ORIGIN", "order is already marked for return-to-origin"),
    ("DELIVERED", "delivered shipments cannot be cancelled"),
    ("CANCELLED", "order is already cancelled")])
def test_finished_orders_have_no_action(spark, status, reason):
    d = evaluate(spark, status=status)
    assert (d.action, d.confidence, d.reason, d.needs_agent) == (None, 1.0, reason, False)


def test_draft_needs_an_agent(spark):
    d = evaluate(spark, status="DRAFT")
    assert (d.needs_agent, d.confidence, d.reason) == (True, 0.0, "no deterministic rule for order status DRAFT")


def test_agreement_over_two_lines_cancels(spark):
    d = evaluate(spark, chunks=[(AGREEMENT, 0.80)])
    assert (d.action.type, d.action.target, d.confidence, d.allowed) == ("CANCEL_ORDER", "O1", 0.95, True)


def test_score_at_the_threshold_is_enough(spark):
    assert evaluate(spark, chunks=[(AGREEMENT, 0.60)]).allowed
    weak = evaluate(spark, chunks=[(AGREEMENT, 0.5999)])
    assert (weak.allowed, weak.needs_agent, weak.confidence, weak.action) == (False, True, 0.5999, None)


def test_best_score_counts_all_chunks_and_ignores_nan(spark):
    assert evaluate(spark, chunks=[(AGREEMENT, 0.1), ("other", 0.7)]).allowed
    assert evaluate(spark, chunks=[("other", float("nan")), ("more", -0.5)]).confidence == 0.0


def test_conflict_escalates(spark):
    d = evaluate(spark, chunks=[(AGREEMENT, 0.9), ("harbor freight  may not cancel", 0.2)])
    assert (d.escalate, d.needs_agent, d.confidence, d.action) == (True, True, 0.0, None)
    assert d.reason == "conflicting customer agreements found for Harbor Freight; cancellation of order O1 requires verification"


def test_default_policy_needs_no_name(spark):
    d = evaluate(spark, chunks=[("BOOKED, not yet PICKED_UP  may be cancelled", 0.4)])
    assert (d.confidence, d.needs_agent) == (0.4, True)
    assert "default policy" in d.reason


def test_name_with_doubled_blanks_never_matches(spark):
    assert not evaluate(spark, name="Harbor  Freight", chunks=[(AGREEMENT.replace("Harbor", "Harbor "), 0.9)]).allowed
    assert evaluate(spark, name="", chunks=[(AGREEMENT, 0.9)]).allowed


def test_newest_security_ticket_wins_whatever_its_status(spark):
    d = evaluate(spark, status="DELIVERED", tickets=["possible API KEY exposure", "Possible API key exposure", "other"])
    assert (d.action.type, d.action.target, d.escalate, d.confidence) == ("ESCALATE", "T1", True, 1.0)


def test_errors_and_missing_order(spark):
    assert evaluate(spark, query="").error == "query cannot be empty"
    assert evaluate(spark, account="A9").error == "load structured context: load account: get account A9: no rows in result set"
    d = evaluate(spark, order="O9")
    assert (d.error, d.reason, d.allowed) == ("load structured context: load order: get order O9: no rows in result set", None, None)
    d = evaluate(spark, order="")
    assert (d.error, d.reason, d.needs_agent) == (None, "order context is required", True)


def test_missing_account_without_loading(spark):
    df = decide.with_evidence(context.request_context(*world(spark, account="A9")[:4]),
                              spark.createDataFrame([], "request_id long, best_score double, agreement_count long, deny_count long, has_policy boolean, has_credit_override boolean"))
    assert decide.decide_cancellation(df).first().reason == "account context is required"


def test_credit_for_a_late_pickup(spark):
    d = credit(spark)
    assert (d.allowed, d.action.type, d.reason) == (True, "SERVICE_CREDIT", "order O1 qualifies for INR 120.00 service credit")


def test_credit_is_capped(spark):
    assert credit(spark, fee=9999.0).reason == "order O1 qualifies for INR 500.00 service credit"


@pytest.mark.parametrize("kw, reason", [
    ({"carrier": False}, "carrier fault is not confirmed"),
    ({"customer": True}, "customer-caused issue makes the order ineligible for a service credit"),
    ({"end": T0 - dt.timedelta(hours=2) + dt.timedelta(seconds=1)}, "pickup is not more than 2 hours past the scheduled pickup window"),
    ({"chunks": [(OVERRIDE, 0.9)]}, "pickup is not more than 4h0m0s past the scheduled pickup window")])
def test_credit_denied(spark, kw, reason):
    d = credit(spark, **kw)
    assert (d.allowed, d.action, d.confidence, d.reason) == (False, None, 1.0, reason)


def test_exact_thresholds_are_eligible(spark):
    assert credit(spark, end=T0 - dt.timedelta(hours=2)).allowed
    d = credit(spark, fee=5000.0, end=T0 - dt.timedelta(hours=4), chunks=[(OVERRIDE, 0.95)])
    assert d.reason == "order O1 qualifies for INR 300.00 service credit under the active customer agreement"


def test_unknown_window_needs_an_agent(spark):
    d = credit(spark, end=None)
    assert (d.needs_agent, d.action, d.confidence) == (True, None, 1.0)


def test_approval_when_the_cap_allows_it(spark):
    d = credit(spark, cap=5000.0, fee=20000.0)
    assert (d.allowed, d.needs_agent, d.action.type) == (False, True, "SERVICE_CREDIT_APPROVAL")
    assert d.action.reason == "manager approval required for INR 2000.00 service credit"
    assert credit(spark, cap=5000.0, fee=10000.0).action.type == "SERVICE_CREDIT"


def test_gates(spark):
    rows = [(1, 0.95, False, ("CANCEL_ORDER", "O1", "r")), (2, 1.0, True, ("ESCALATE", "T1", "r")),
            (3, 0.89, False, ("X", "O1", "r")), (4, 1.0, False, None), (5, None, None, None), (6, 0.90, False, ("X", "O2", "r"))]
    df = spark.createDataFrame(rows, "request_id long, confidence double, escalate boolean, action struct<type:string,target:string,reason:string>")
    held = decide.gate(df)
    assert rows_of(held, "request_id", "confirmation_required") == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, True)]
    assert rows_of(decide.gate(df, "auto"), "request_id", "execute") == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True)]
    assert rows_of(held, "confirmation_id") == rows_of(decide.gate(df), "confirmation_id")
    with pytest.raises(ValueError):
        decide.gate(df, "never")


def test_evaluate_of_a_union_is_the_union(spark):
    r, a, o, t, e = world(spark, chunks=[(AGREEMENT, 0.9)])
    r2 = r.withColumn("request_id", F.lit(2).cast("long"))
    both = decide.evaluate_requests(r.unionAll(r2), a, o, t, e)
    apart = decide.evaluate_requests(r, a, o, t, e).unionAll(decide.evaluate_requests(r2, a, o, t, e))
    assert rows_of(both) == rows_of(apart)


def test_account_tickets_are_ranked_across_hours(spark):
    n = 300
    rows = [(f"T{i:03d}", "A1" if i % 3 else "A2", T0 + dt.timedelta(minutes=7 * (i // 2)), "open", "s") for i in range(n)]
    df = spark.createDataFrame(rows, "ticket_id string, account_id string, created_at timestamp, status string, subject string")
    found = {(r.account_id, r.ticket_id): r.position for r in context.account_tickets(df).collect()}
    for account in ("A1", "A2"):
        order = sorted((r for r in rows if r[1] == account), key=lambda r: (r[2], r[0]), reverse=True)
        assert [found[(account, r[0])] for r in order] == list(range(1, len(order) + 1))
