"""Applying actions to orders and tickets: validated, idempotent, audited.

Every status graph has one step and a dead end, so what an action finds depends only on the
earliest action of each kind on its target. Those are conditional minima per target, combined
map-side; no target's actions are sorted or collected, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.scalars import credit_amount, stored_amount
from casework.operators.joins import lookup
from casework.schemas import ACTIVE_CREDIT_STATUSES
from casework.workspace import freeze

CREDIT_TYPES = ("SERVICE_CREDIT", "SERVICE_CREDIT_APPROVAL")
ORDER_TYPES = ("CANCEL_ORDER", "RETURN_TO_ORIGIN", *CREDIT_TYPES)
ACTION_TYPES = (*ORDER_TYPES, "ESCALATE")
_NOT_FOUND = ": no rows in result set"


def with_active_escalation(tickets: DataFrame, escalations: DataFrame) -> DataFrame:
    """Tickets that already have a created escalation."""
    active = escalations.where(F.col("status") == "created").select("ticket_id")
    return tickets.join(active, "ticket_id", "left_semi")


def with_active_credit(orders: DataFrame, credits: DataFrame) -> DataFrame:
    """Orders that already have a credit pending, approved or issued."""
    active = credits.where(F.col("status").isin(*ACTIVE_CREDIT_STATUSES)).select("order_id")
    return orders.join(active, "order_id", "left_semi")


def _kind() -> Column:
    return F.when(F.col("action_type") == "ESCALATE", "ticket").otherwise("order")


def _load_error() -> Column:
    kind, target = F.col("action_type"), F.col("target_id")
    what = (
        F.when(kind == "ESCALATE", F.concat(F.lit("load ticket "), target))
        .when(kind == "SERVICE_CREDIT",
              F.concat(F.lit("load order "), target, F.lit(" for service credit")))
        .when(kind == "SERVICE_CREDIT_APPROVAL",
              F.concat(F.lit("load order "), target, F.lit(" for credit approval")))
        .otherwise(F.concat(F.lit("load order "), target))
    )
    return F.concat(what, F.lit(_NOT_FOUND))


def _request_error() -> Column:
    """Errors an action carries in itself, before any state is read."""
    kind = F.col("action_type")
    blank = F.coalesce("target_id", F.lit("")) == ""
    return (
        F.when(kind.isNull(), "action is nil")
        .when(~kind.isin(*ACTION_TYPES), F.concat(F.lit("unsupported action type: "), kind))
        .when(blank & (kind == "ESCALATE"), "ticket ID is required for escalation")
        .when(blank & (kind == "SERVICE_CREDIT"), "order ID is required for service credit")
        .when(blank & (kind == "SERVICE_CREDIT_APPROVAL"),
              "order ID is required for service credit approval")
        .when(blank, "order ID is required")
    )


def action_errors(actions: DataFrame) -> DataFrame:
    """Actions refused for what they are, whatever the state of their target."""
    refused = actions.withColumn("error", _request_error())
    return refused.where(F.col("error").isNotNull())


def action_target_state(actions: DataFrame, orders: DataFrame, tickets: DataFrame) -> DataFrame:
    """Actions with the current state of their target, or the error of loading it."""
    states = orders.select(
        F.lit("order").alias("_kind"), F.col("order_id").alias("target_id"), "account_id",
        F.col("status").alias("target_status"),
    ).unionByName(
        tickets.select(
            F.lit("ticket").alias("_kind"), F.col("ticket_id").alias("target_id"), "account_id",
            F.col("status").alias("target_status"),
        )
    ).withColumn("_found", F.lit(True))
    usable = actions.withColumn("error", _request_error()).withColumn("_kind", _kind())
    joined = lookup(usable, states, ["_kind", "target_id"])
    error = F.coalesce("error", F.when(F.col("_found").isNull(), _load_error()))
    state = {c: F.when(error.isNull(), F.col(c)) for c in ("account_id", "target_status")}
    return joined.withColumns({**state, "error": error}).select(
        *actions.columns, "account_id", "target_status", "error"
    )


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("seq")))


def _target_states(
    usable: DataFrame, orders: DataFrame, tickets: DataFrame,
    escalations: DataFrame, credits: DataFrame,
) -> DataFrame:
    """One row per target: its state now and the ``seq`` at which each change happens."""
    kind, given = F.col("action_type"), F.col("amount_inr")
    is_credit = kind.isin(*CREDIT_TYPES)
    firsts = usable.groupBy("_kind", "target_id").agg(
        _first(kind == "CANCEL_ORDER").alias("_cancel"),
        _first(kind == "RETURN_TO_ORIGIN").alias("_return"),
        _first(is_credit & given.isNull()).alias("_credit"),
        _first(is_credit & stored_amount(given).isNotNull()).alias("_given_credit"),
        _first(kind == "ESCALATE").alias("_escalate"),
    )
    firsts = freeze(firsts, "targets")  # of known size, so a small batch is what gets broadcast
    targets = firsts.select(F.col("target_id").alias("order_id")).where(F.col("_kind") == "order")
    with_credit = with_active_credit(targets, credits).select(
        "order_id", F.lit(True).alias("_active")
    )
    fee_credit = credit_amount(F.col("shipment_fee_inr"))
    order_side = (
        firsts.where(F.col("_kind") == "order")
        .join(orders.select(F.col("order_id").alias("target_id"), "account_id",
                            F.col("status").alias("_status"), "shipment_fee_inr"), "target_id")
        .join(with_credit.withColumnRenamed("order_id", "target_id"), "target_id", "left")
    )
    booked = F.col("_status") == "BOOKED"
    cancel_at = F.when(booked, F.col("_cancel"))
    candidate = F.least(
        F.when(stored_amount(fee_credit).isNotNull(), F.col("_credit")), F.col("_given_credit")
    )
    free = booked & F.col("_active").isNull()
    order_side = order_side.select(
        "_kind", "target_id", "account_id", "_status",
        F.coalesce("_active", F.lit(False)).alias("_active"),
        fee_credit.alias("_fee_credit"),
        cancel_at.alias("_cancel_at"),
        F.when(F.col("_status") == "PICKED_UP", F.col("_return")).alias("_return_at"),
        F.when(free & (cancel_at.isNull() | (candidate < cancel_at)), candidate).alias("_credit_at"),
        F.lit(None).cast("bigint").alias("_escalate_at"),
    )

    targets = firsts.select(F.col("target_id").alias("ticket_id")).where(F.col("_kind") == "ticket")
    escalated = with_active_escalation(targets, escalations).select(
        F.col("ticket_id").alias("target_id"), F.lit(True).alias("_active")
    )
    ticket_side = (
        firsts.where(F.col("_kind") == "ticket")
        .join(tickets.select(F.col("ticket_id").alias("target_id"), "account_id",
                             F.col("status").alias("_status")), "target_id")
        .join(escalated, "target_id", "left")
        .select(
            "_kind", "target_id", "account_id", "_status",
            F.coalesce("_active", F.lit(False)).alias("_active"),
            F.lit(None).cast("double").alias("_fee_credit"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("_cancel_at", "_return_at", "_credit_at")],
            F.when(F.col("_active").isNull(), F.col("_escalate")).alias("_escalate_at"),
        )
    )
    return order_side.unionByName(ticket_side)


def apply_action_sequence(
    actions: DataFrame,
    orders: DataFrame,
    tickets: DataFrame,
    escalations: DataFrame,
    credits: DataFrame,
    honor_agreement: bool = False,
) -> DataFrame:
    """Outcome of every action, each seeing what its predecessors (by unique ``seq``) left.

    ``outcome`` is executed, noop or error (with text). ``status_before`` is the target's status
    the action met. Credits follow the fee rule; with ``honor_agreement`` an ``amount_inr`` on the
    action is used instead where present.
    """
    given = F.col("amount_inr").cast("double") if honor_agreement else F.lit(None).cast("double")
    prepared = actions.withColumns(
        {"amount_inr": given, "seq": F.col("seq").cast("bigint"), "_kind": _kind(),
         "_refused": _request_error()}
    )
    usable = prepared.where(F.col("_refused").isNull())
    states = _target_states(usable, orders, tickets, escalations, credits)
    rows = lookup(prepared, states.withColumn("_found", F.lit(True)), ["_kind", "target_id"])

    kind, target, seq = F.col("action_type"), F.col("target_id"), F.col("seq")
    status = (
        F.when(seq > F.col("_cancel_at"), "CANCELLED")
        .when(seq > F.col("_return_at"), "RETURN_TO_ORIGIN")
        .otherwise(F.col("_status"))
    )
    amount = F.coalesce("amount_inr", "_fee_credit")
    taken = F.col("_active") | F.coalesce(seq > F.col("_credit_at"), F.lit(False))
    is_credit = kind.isin(*CREDIT_TYPES)

    def refusal(verb: str, tail: str = "") -> Column:
        return F.concat(F.lit(verb), target, F.lit(f"{tail} in status "), status)

    store_verb = F.when(kind == "SERVICE_CREDIT", "issue service credit").otherwise(
        "create service credit approval"
    )
    error = (
        F.when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(F.col("_found").isNull(), _load_error())
        .when((kind == "CANCEL_ORDER") & ~status.isin("BOOKED", "CANCELLED"),
              refusal("cannot cancel order "))
        .when((kind == "RETURN_TO_ORIGIN") & ~status.isin("PICKED_UP", "RETURN_TO_ORIGIN"),
              refusal("cannot return order ", " to origin"))
        .when((kind == "SERVICE_CREDIT") & (status != "BOOKED"),
              refusal("cannot issue service credit for order "))
        .when((kind == "SERVICE_CREDIT_APPROVAL") & (status != "BOOKED"),
              refusal("cannot request service credit approval for order "))
        .when(is_credit & ~taken & (amount <= 0),
              F.concat(F.lit("invalid service credit amount for order "), target))
        .when(is_credit & ~taken & stored_amount(amount).isNull(),
              F.concat(store_verb, F.lit(": amount_inr does not fit the table")))
    )
    executed = (
        F.when(kind == "CANCEL_ORDER", status == "BOOKED")
        .when(kind == "RETURN_TO_ORIGIN", status == "PICKED_UP")
        .when(kind == "ESCALATE", F.coalesce(seq == F.col("_escalate_at"), F.lit(False)))
        .when(is_credit, F.coalesce(seq == F.col("_credit_at"), F.lit(False)))
    )
    outcome = F.when(error.isNotNull(), "error").when(executed, "executed").otherwise("noop")
    known = F.col("_found").isNotNull() & F.col("_refused").isNull()
    return rows.select(
        *[c for c in actions.columns if c != "amount_inr"],
        F.when(known, F.col("account_id")).alias("account_id"),
        F.when(known, status).alias("status_before"),
        F.when(is_credit & (outcome == "executed"), amount).alias("amount"),
        outcome.alias("outcome"),
        error.alias("error"),
    )


def _executed(outcomes: DataFrame, *kinds: str) -> DataFrame:
    return outcomes.where((F.col("outcome") == "executed") & F.col("action_type").isin(*kinds))


def order_changes(outcomes: DataFrame) -> DataFrame:
    """Status changes, at most one per order: (order_id, new_status, changed_at)."""
    return _executed(outcomes, "CANCEL_ORDER", "RETURN_TO_ORIGIN").select(
        F.col("target_id").alias("order_id"),
        F.when(F.col("action_type") == "CANCEL_ORDER", "CANCELLED")
        .otherwise("RETURN_TO_ORIGIN").alias("new_status"),
        F.col("acted_at").alias("changed_at"),
    )


def orders_after(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Orders with the changes applied; a cancellation also stamps its request time."""
    joined = orders.join(changes, "order_id", "left")
    changed = F.col("new_status").isNotNull()
    updated = {"status": F.coalesce("new_status", "status")}
    if "updated_at" in orders.columns:
        updated["updated_at"] = F.when(changed, F.col("changed_at")).otherwise(F.col("updated_at"))
    if "cancellation_requested_at" in orders.columns:
        updated["cancellation_requested_at"] = F.when(
            F.col("new_status") == "CANCELLED", F.col("changed_at")
        ).otherwise(F.col("cancellation_requested_at"))
    return joined.withColumns(updated).select(*orders.columns)


def new_escalations(outcomes: DataFrame) -> DataFrame:
    return _executed(outcomes, "ESCALATE").select(
        F.col("target_id").alias("ticket_id"), "account_id", "reason",
        F.lit("P1").alias("priority"), F.lit("created").alias("status"),
        F.lit("agent").alias("requested_by"), F.col("acted_at").alias("created_at"),
    )


def new_credits(outcomes: DataFrame) -> DataFrame:
    issued = F.col("action_type") == "SERVICE_CREDIT"
    return _executed(outcomes, *CREDIT_TYPES).select(
        F.col("target_id").alias("order_id"), "account_id",
        stored_amount(F.col("amount")).alias("amount_inr"), "reason",
        F.when(issued, "ISSUED").otherwise("PENDING_APPROVAL").alias("status"),
        F.lit("agent").alias("requested_by"),
        F.when(issued, F.col("acted_at")).alias("issued_at"),
        F.col("acted_at").alias("created_at"),
    )


def audit_rows(outcomes: DataFrame) -> DataFrame:
    """One row per executed action with both states as JSON; the amount is left unrounded."""
    kind = F.col("action_type")

    def state(**fields) -> Column:
        parts = [v if isinstance(v, Column) else F.lit(v) for v in fields.values()]
        return F.to_json(F.struct(*[p.alias(n) for p, n in zip(parts, fields)]))

    before = (
        F.when(kind == "CANCEL_ORDER", state(status="BOOKED"))
        .when(kind == "RETURN_TO_ORIGIN", state(status="PICKED_UP"))
        .otherwise(F.lit("{}"))
    )
    credit_status = F.when(kind == "SERVICE_CREDIT", "ISSUED").otherwise("PENDING_APPROVAL")
    after = (
        F.when(kind == "CANCEL_ORDER", state(status="CANCELLED"))
        .when(kind == "RETURN_TO_ORIGIN", state(status="RETURN_TO_ORIGIN"))
        .when(kind == "ESCALATE", state(priority="P1", requested_by="agent", status="created"))
        .otherwise(state(amount_inr=F.col("amount"), requested_by="agent", status=credit_status))
    )
    return _executed(outcomes, *ACTION_TYPES).select(
        F.col("seq").alias("id"), "account_id", "action_type", "target_id", "reason",
        before.alias("previous_state"), after.alias("new_state"),
        F.col("acted_at").alias("created_at"),
    )
