import datetime as dt
import json
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.operators import actions as act

T0 = dt.datetime(2026, 8, 16, 12)
ACTIONS = "seq long, action_type string, target_id string, reason string, acted_at timestamp, amount_inr double"
ORDERS = ("order_id string, account_id string, status string, shipment_fee_inr decimal(12,2), "
          "cancellation_requested_at timestamp, updated_at timestamp")
TICKETS = "ticket_id string, account_id string, status string"


def run(spark, actions, orders=(), tickets=(), escalations=(), credits=(), **kw):
    from decimal import Decimal

    made = [(i, t, target, f"r{i}", T0 + dt.timedelta(minutes=i), amount)
            for i, (t, target, amount) in enumerate([(*a, None)[:3] for a in actions], 1)]
    return act.apply_action_sequence(
        spark.createDataFrame(made, ACTIONS),
        spark.createDataFrame([(o, "A1", s, Decimal(str(f)), None, T0) for o, s, f in orders], ORDERS),
        spark.createDataFrame([(t, "A1", "open") for t in tickets], TICKETS),
        spark.createDataFrame(list(escalations), "ticket_id string, status string"),
        spark.createDataFrame(list(credits), "order_id string, status string"),
        **kw,
    )


def outcome(*args, **kw):
    return [(r.outcome, r.error) for r in run(*args, **kw).orderBy("seq").collect()]


def test_cancel_then_again(spark):
    assert outcome(spark, [("CANCEL_ORDER", "O")] * 2, [("O", "BOOKED", 10)]) == [("executed", None), ("noop", None)]


def test_return_then_again(spark):
    assert outcome(spark, [("RETURN_TO_ORIGIN", "O")] * 2, [("O", "PICKED_UP", 10)]) == [("executed", None), ("noop", None)]


@pytest.mark.parametrize("kind, status, error", [
    ("CANCEL_ORDER", "PICKED_UP", "cannot cancel order O in status PICKED_UP"),
    ("CANCEL_ORDER", "RETURN_TO_ORIGIN", "cannot cancel order O in status RETURN_TO_ORIGIN"),
    ("RETURN_TO_ORIGIN", "BOOKED", "cannot return order O to origin in status BOOKED"),
    ("SERVICE_CREDIT", "DELIVERED", "cannot issue service credit for order O in status DELIVERED"),
    ("SERVICE_CREDIT_APPROVAL", "DRAFT", "cannot request service credit approval for order O in status DRAFT")])
def test_wrong_state(spark, kind, status, error):
    assert outcome(spark, [(kind, "O")], [("O", status, 10)]) == [("error", error)]


@pytest.mark.parametrize("kind, target, error", [
    (None, "O", "action is nil"), ("REFUND", "", "unsupported action type: REFUND"),
    ("CANCEL_ORDER", "", "order ID is required"), ("RETURN_TO_ORIGIN", None, "order ID is required"),
    ("ESCALATE", "", "ticket ID is required for escalation"),
    ("SERVICE_CREDIT", "", "order ID is required for service credit"),
    ("SERVICE_CREDIT_APPROVAL", "", "order ID is required for service credit approval"),
    ("CANCEL_ORDER", "X", "load order X: no rows in result set"),
    ("ESCALATE", "X", "load ticket X: no rows in result set"),
    ("SERVICE_CREDIT", "X", "load order X for service credit: no rows in result set"),
    ("SERVICE_CREDIT_APPROVAL", "X", "load order X for credit approval: no rows in result set")])
def test_refused(spark, kind, target, error):
    assert outcome(spark, [(kind, target)], [("O", "BOOKED", 10)], ["T"]) == [("error", error)]


def test_escalation_is_created_once(spark):
    out = run(spark, [("ESCALATE", "T")] * 2 + [("ESCALATE", "U")], tickets=["T", "U"], escalations=[("U", "created"), ("T", "cancelled")])
    assert rows_of(out, "outcome", "target_id") == [("executed", "T"), ("noop", "T"), ("noop", "U")]
    made = act.new_escalations(out).first()
    assert (made.priority, made.status, made.requested_by, made.account_id) == ("P1", "created", "agent", "A1")
    audit = act.audit_rows(out).first()
    assert audit.previous_state == "{}"
    assert json.loads(audit.new_state) == {"priority": "P1", "status": "created", "requested_by": "agent"}


def test_credit_amounts(spark):
    out = run(spark, [("SERVICE_CREDIT", "A"), ("SERVICE_CREDIT_APPROVAL", "B"), ("SERVICE_CREDIT", "C"), ("SERVICE_CREDIT", "D")],
              [("A", "BOOKED", 1200), ("B", "BOOKED", 99999), ("C", "BOOKED", 0), ("D", "BOOKED", 0.04)])
    assert rows_of(act.new_credits(out), "order_id", F.col("amount_inr").cast("double"), "status", F.col("issued_at").isNull()) == [
        ("A", 120.0, "ISSUED", False), ("B", 500.0, "PENDING_APPROVAL", True)]
    assert rows_of(out.where("outcome = 'error'"), "target_id", "error") == [
        ("C", "invalid service credit amount for order C"), ("D", "issue service credit: amount_inr does not fit the table")]


def test_audit_keeps_the_unrounded_amount(spark):
    out = run(spark, [("SERVICE_CREDIT", "A")], [("A", "BOOKED", 10.05)])
    assert json.loads(act.audit_rows(out).first().new_state) == {"amount_inr": 10.05 * 0.1, "requested_by": "agent", "status": "ISSUED"}


def test_active_credit_is_checked_before_the_amount(spark):
    orders = [("O", "BOOKED", 0)]
    assert outcome(spark, [("SERVICE_CREDIT", "O")], orders, credits=[("O", "APPROVED")]) == [("noop", None)]
    assert outcome(spark, [("SERVICE_CREDIT", "O")], [("O", "BOOKED", 10)], credits=[("O", "REJECTED")]) == [("executed", None)]


def test_credit_after_cancellation_is_refused(spark):
    steps = [("SERVICE_CREDIT", "O"), ("CANCEL_ORDER", "O"), ("SERVICE_CREDIT", "O")]
    assert [o for o, _ in outcome(spark, steps, [("O", "BOOKED", 10)])] == ["executed", "executed", "error"]


def test_agreed_amount_only_on_request(spark):
    step = [("SERVICE_CREDIT", "O", 300.0)]
    orders = [("O", "BOOKED", 10)]
    assert run(spark, step, orders).first().amount == 1.0
    assert run(spark, step, orders, honor_agreement=True).first().amount == 300.0


def test_orders_after(spark):
    orders = [("A", "BOOKED", 1), ("B", "PICKED_UP", 1), ("C", "BOOKED", 1)]
    out = run(spark, [("CANCEL_ORDER", "A"), ("RETURN_TO_ORIGIN", "B")], orders)
    base = spark.createDataFrame([(o, "A1", s, None, None, T0) for o, s, _ in orders], ORDERS)
    found = rows_of(act.orders_after(base, act.order_changes(out)), "order_id", "status", "cancellation_requested_at", "updated_at")
    assert found == [("A", "CANCELLED", T0 + dt.timedelta(minutes=1), T0 + dt.timedelta(minutes=1)),
                     ("B", "RETURN_TO_ORIGIN", None, T0 + dt.timedelta(minutes=2)), ("C", "BOOKED", None, T0)]


def simulate(steps, orders, tickets, escalations, credits, honor):
    """The rules one action at a time, against mutable state."""
    status = {o: s for o, s, _ in orders}
    fee = {o: f for o, _, f in orders}
    escalated = {t for t, s in escalations if s == "created"}
    credited = {o for o, s in credits if s in ("PENDING_APPROVAL", "APPROVED", "ISSUED")}
    out = []
    for kind, target, given in steps:
        result = "error"
        if kind == "ESCALATE":
            if target in tickets:
                result = "noop" if target in escalated else "executed"
                escalated.add(target)
        elif target in status:
            now = status[target]
            if kind in ("CANCEL_ORDER", "RETURN_TO_ORIGIN"):
                start, end = ("BOOKED", "CANCELLED") if kind == "CANCEL_ORDER" else ("PICKED_UP", "RETURN_TO_ORIGIN")
                result = "executed" if now == start else "noop" if now == end else "error"
                if now == start:
                    status[target] = end
            elif kind in ("SERVICE_CREDIT", "SERVICE_CREDIT_APPROVAL") and now == "BOOKED":
                amount = given if honor and given is not None else min(fee[target] * 0.1, 500)
                if target in credited:
                    result = "noop"
                elif round(amount + 1e-9, 2) > 0:
                    result = "executed"
                    credited.add(target)
        out.append(result)
    return out


@pytest.mark.parametrize("seed, honor", [(1, False), (2, True), (3, False)])
def test_sequences_equal_a_simulation(spark, seed, honor):
    rng = random.Random(seed)
    statuses = ["DRAFT", "BOOKED", "BOOKED", "PICKED_UP", "RETURN_TO_ORIGIN", "DELIVERED", "CANCELLED"]
    orders = [(f"O{i}", rng.choice(statuses), rng.choice([0, 0.04, 50, 99999])) for i in range(40)]
    tickets = [f"T{i}" for i in range(8)]
    escalations = [(t, rng.choice(["created", "cancelled"])) for t in tickets if rng.random() < 0.4]
    credits = [(o, rng.choice(["REJECTED", "ISSUED"])) for o, _, _ in orders if rng.random() < 0.2]
    kinds = [*act.ACTION_TYPES, "REFUND"]
    steps = []
    for _ in range(900):
        kind = rng.choice(kinds)
        pool = tickets + ["T99"] if kind == "ESCALATE" else [o for o, _, _ in orders] + ["O99", "O1", "O1", "O1"]
        steps.append((kind, rng.choice(pool), rng.choice([None, None, -1.0, 0.004, 300.0])))
    found = [o for o, _ in outcome(spark, steps, orders, tickets, escalations, credits, honor_agreement=honor)]
    assert found == simulate(steps, orders, tickets, escalations, credits, honor)


def test_replay_changes_nothing(spark):
    steps = [("CANCEL_ORDER", "A"), ("RETURN_TO_ORIGIN", "B"), ("SERVICE_CREDIT", "C"), ("ESCALATE", "T")]
    orders = [("A", "BOOKED", 10), ("B", "PICKED_UP", 10), ("C", "BOOKED", 10)]
    assert [o for o, _ in outcome(spark, steps, orders, ["T"])] == ["executed"] * 4
    after = [("A", "CANCELLED", 10), ("B", "RETURN_TO_ORIGIN", 10), ("C", "BOOKED", 10)]
    again = outcome(spark, steps, after, ["T"], [("T", "created")], [("C", "ISSUED")])
    assert again == [("noop", None)] * 4
