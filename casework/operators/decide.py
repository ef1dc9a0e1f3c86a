"""Evidence aggregates and the ordered decision rules, first match wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.phrases import phrase_flags
from casework.functions.scalars import credit_amount, money_text
from casework.functions.text import normalize_match_text
from casework.operators.context import request_account, request_context, request_order
from casework.operators.joins import aggregate_apart, lookup
from casework.schemas import (
    AGREEMENT_CONFIDENCE,
    CREDIT_APPROVAL_LIMIT,
    CREDIT_CAP,
    DELAY_HOURS,
    GATE_CONFIDENCE,
    MIN_AGREEMENT_SCORE,
    OVERRIDE_CREDIT,
    OVERRIDE_DELAY_HOURS,
)


def evidence_summary(names: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per request of ``names`` (request_id, account_name), what its chunks say.

    ``best_score`` is the maximum over all chunks and starts at 0; NaN scores never raise it.
    Requests without chunks have no row here: see ``with_evidence``.
    """
    chunks = evidence.select("request_id", "content", "score")
    found = lookup(chunks, names.select("request_id", "account_name"), "request_id", "inner")
    said = found.withColumn("text", normalize_match_text(F.col("content")))
    flags = phrase_flags(F.col("text"), F.col("account_name"))
    flagged = said.select("request_id", "score", *[c.alias(n) for n, c in flags.items()])
    score = F.when(~F.isnan("score"), F.col("score"))
    return aggregate_apart(
        flagged,
        "request_id",
        best_score=F.greatest(F.lit(0.0), F.coalesce(F.max(score), F.lit(0.0))),
        agreement_count=F.count_if("is_agreement"),
        deny_count=F.count_if("is_deny"),
        has_policy=F.bool_or("is_policy"),
        has_credit_override=F.bool_or("is_credit_override"),
    )


def with_evidence(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """Requests with their evidence summary; none found means zeros and false."""
    empty = {"best_score": 0.0, "agreement_count": 0, "deny_count": 0,
             "has_policy": False, "has_credit_override": False}
    joined = requests.join(summary, "request_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in empty.items()})


def _names(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    ids = requests.select("request_id", "account_id")
    return lookup(ids, accounts.select("account_id", "account_name"), "account_id", "inner")


@dataclass(frozen=True)
class Rule:
    """What one rule answers. Texts may name columns in braces; ``confidence`` is SQL."""

    reason: str
    confidence: str = "0.0D"
    allowed: bool = False
    needs_agent: bool = False
    escalate: bool = False
    action: tuple[str, str, str] | None = None  # type, target column, reason


# The reference's second conflict test needs more than one agreement and a denial; any such row
# is already caught by the first, so there is one conflict rule.
# The answer texts, confidences and action reasons of both rule tables.
CANCELLATION_RULES = {
    "no_account": Rule("account context is required", needs_agent=True),
    "security": Rule(
        "suspected production credential exposure requires P1 handling", "1.0D", escalate=True,
        action=("ESCALATE", "security_ticket_id", "suspected API key exposure"),
    ),
    "no_order": Rule("order context is required", needs_agent=True),
    "picked_up": Rule(
        "picked-up shipments cannot be cancelled; use return-to-origin", "1.0D",
        action=("RETURN_TO_ORIGIN", "order_id", "shipment already picked up"),
    ),
    "returning": Rule("order is already marked for return-to-origin", "1.0D"),
    "delivered": Rule("delivered shipments cannot be cancelled", "1.0D"),
    "cancelled": Rule("order is already cancelled", "1.0D"),
    "other_status": Rule("no deterministic rule for order status {order_status}", needs_agent=True),
    "conflict": Rule(
        "conflicting customer agreements found for {account_name}; cancellation of order "
        "{order_id} requires verification",
        needs_agent=True, escalate=True,
    ),
    "agreement": Rule(
        "{account_name} may cancel BOOKED order {order_id} before pickup with no cancellation fee "
        "under the active customer agreement",
        f"{AGREEMENT_CONFIDENCE}D", allowed=True,
        action=("CANCEL_ORDER", "order_id",
                "active customer agreement overrides the default cancellation fee policy"),
    ),
    "weak_agreement": Rule(
        "customer agreement appears to permit cancellation of BOOKED order {order_id}, but "
        "evidence confidence is insufficient for an automatic action",
        "best_score", needs_agent=True,
    ),
    "default_policy": Rule(
        "BOOKED order {order_id} may be cancellable under the default policy, but no "
        "customer-specific agreement was verified",
        "best_score", needs_agent=True,
    ),
    "no_evidence": Rule(
        "BOOKED order {order_id} requires policy/agreement evaluation", "best_score",
        needs_agent=True,
    ),
}

CREDIT_RULES = {
    "no_account": Rule("account context is required", needs_agent=True),
    "no_order": Rule("order context is required for service-credit evaluation", needs_agent=True),
    "no_window": Rule(
        "pickup window end is unknown; service-credit eligibility cannot be verified", "1.0D",
        needs_agent=True,
    ),
    "on_time": Rule("pickup is not more than 2 hours past the scheduled pickup window", "1.0D"),
    "no_carrier_fault": Rule("carrier fault is not confirmed", "1.0D"),
    "customer_fault": Rule(
        "customer-caused issue makes the order ineligible for a service credit", "1.0D"
    ),
    "on_time_by_agreement": Rule(
        "pickup is not more than 4h0m0s past the scheduled pickup window", "1.0D"
    ),
    "approval": Rule(
        "service credit of INR {_money} requires manager approval", "1.0D", needs_agent=True,
        action=("SERVICE_CREDIT_APPROVAL", "order_id",
                "manager approval required for INR {_money} service credit"),
    ),
    "agreed_credit": Rule(
        "order {order_id} qualifies for INR {_money} service credit under the active customer "
        "agreement",
        "1.0D", allowed=True,
        action=("SERVICE_CREDIT", "order_id",
                "order {order_id} qualifies for INR {_money} service credit under the active "
                "customer agreement"),
    ),
    "credit": Rule(
        "order {order_id} qualifies for INR {_money} service credit", "1.0D", allowed=True,
        action=("SERVICE_CREDIT", "order_id",
                "order {order_id} qualifies for INR {_money} service credit"),
    ),
}


def cancellation_rule(min_score: float = MIN_AGREEMENT_SCORE) -> Column:
    """Name of the first rule that holds for a row of request, account, order and evidence."""
    return F.expr(
        f"""CASE
          WHEN NOT account_found THEN 'no_account'
          WHEN security_ticket_id IS NOT NULL THEN 'security'
          WHEN NOT order_found THEN 'no_order'
          WHEN order_status = 'PICKED_UP' THEN 'picked_up'
          WHEN order_status = 'RETURN_TO_ORIGIN' THEN 'returning'
          WHEN order_status = 'DELIVERED' THEN 'delivered'
          WHEN order_status = 'CANCELLED' THEN 'cancelled'
          WHEN order_status <> 'BOOKED' THEN 'other_status'
          WHEN agreement_count > 0 AND deny_count > 0 THEN 'conflict'
          WHEN agreement_count > 0 AND best_score >= {min_score}D THEN 'agreement'
          WHEN agreement_count > 0 THEN 'weak_agreement'
          WHEN has_policy THEN 'default_policy'
          ELSE 'no_evidence' END"""
    )


def credit_rule(approval_limit: float = CREDIT_APPROVAL_LIMIT) -> Column:
    """Name of the first service-credit rule that holds; a delay of exactly the threshold counts.

    Needs ``_credit``, the amount on offer. With the default cap the approval rule cannot fire;
    it does when the cap is raised above ``approval_limit``.
    """
    return F.expr(
        f"""CASE
          WHEN NOT account_found THEN 'no_account'
          WHEN NOT order_found THEN 'no_order'
          WHEN pickup_window_end IS NULL THEN 'no_window'
          WHEN requested_at < pickup_window_end + INTERVAL '{DELAY_HOURS}' HOUR THEN 'on_time'
          WHEN NOT carrier_fault THEN 'no_carrier_fault'
          WHEN customer_fault THEN 'customer_fault'
          WHEN has_credit_override
            AND requested_at < pickup_window_end + INTERVAL '{OVERRIDE_DELAY_HOURS}' HOUR
            THEN 'on_time_by_agreement'
          WHEN _credit > {approval_limit}D THEN 'approval'
          WHEN has_credit_override THEN 'agreed_credit'
          ELSE 'credit' END"""
    )


def _text(template: str) -> str:
    """``"order {order_id} …"`` as a SQL concatenation."""
    pieces = [
        name if i % 2 else f"'{name}'" for i, name in enumerate(re.split(r"[{}]", template)) if name
    ]
    return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"


def _answers(rows: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Rows with a ``_rule`` name to rows with the decision it stands for; null stays null."""

    def named(flag: str) -> str:
        names = [f"'{n}'" for n, r in rules.items() if getattr(r, flag)]
        return f"_rule IN ({', '.join(names)})" if names else "if(_rule IS NULL, NULL, false)"

    def case(pick) -> str:
        arms = [(n, pick(r)) for n, r in rules.items()]
        return "CASE _rule " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in arms if v) + " END"

    action = [case(lambda r, i=i: r.action and (r.action[1] if i == 1 else _text(r.action[i])))
              for i in range(3)]
    acting = [f"'{n}'" for n, r in rules.items() if r.action]
    return rows.selectExpr(
        "*",
        *[f"{named(flag)} AS {flag}" for flag in ("allowed", "needs_agent", "escalate")],
        f"{case(lambda r: r.confidence)} AS confidence",
        f"{case(lambda r: _text(r.reason))} AS reason",
        f"""CASE WHEN _rule IN ({', '.join(acting)}) THEN
              named_struct('type', {action[0]}, 'target', {action[1]}, 'reason', {action[2]})
            END AS action""",
    )


_DECISION = ("allowed", "needs_agent", "escalate", "confidence", "reason", "action")


def decide_cancellation(context: DataFrame, min_score: float = MIN_AGREEMENT_SCORE) -> DataFrame:
    """Adds the decision to rows of request, account, order and evidence columns."""
    return _answers(context.withColumn("_rule", cancellation_rule(min_score)), CANCELLATION_RULES)


def decide_service_credit(
    context: DataFrame, cap: float = CREDIT_CAP, approval_limit: float = CREDIT_APPROVAL_LIMIT
) -> DataFrame:
    """Adds the service-credit decision as of ``requested_at``."""
    credit = F.when(F.col("has_credit_override"), F.lit(OVERRIDE_CREDIT)).otherwise(
        credit_amount(F.col("shipment_fee"), cap=cap)
    )
    priced = context.withColumn("_credit", credit).withColumn("_money", money_text(F.col("_credit")))
    return _answers(priced.withColumn("_rule", credit_rule(approval_limit)), CREDIT_RULES)


def evaluate_requests(
    requests: DataFrame,
    accounts: DataFrame,
    orders: DataFrame,
    tickets: DataFrame,
    evidence: DataFrame,
    min_score: float = MIN_AGREEMENT_SCORE,
) -> DataFrame:
    """One decision per request; where loading failed, ``error`` and no decision.

    ``answer`` is what the requester is told: the decision's reason. Its sources are the rows of
    ``evidence`` with the same request_id.
    """
    context = request_context(requests, accounts, orders, tickets)
    summary = evidence_summary(context, evidence)
    rule = F.when(F.col("error").isNull(), cancellation_rule(min_score))
    decided = _answers(with_evidence(context, summary).withColumn("_rule", rule), CANCELLATION_RULES)
    return decided.select(
        "request_id", "account_id", "order_id", "error", "order_account_mismatch", *_DECISION,
        F.col("reason").alias("answer"),
    )


def service_credit_decisions(
    requests: DataFrame,
    accounts: DataFrame,
    orders: DataFrame,
    tickets: DataFrame,
    evidence: DataFrame,
    cap: float = CREDIT_CAP,
    approval_limit: float = CREDIT_APPROVAL_LIMIT,
) -> DataFrame:
    """One service-credit decision per request, whatever its query says."""
    context = request_order(request_account(requests, accounts), orders)
    summary = evidence_summary(context, evidence)
    decided = decide_service_credit(with_evidence(context, summary), cap, approval_limit)
    return decided.select("request_id", "account_id", "order_id", *_DECISION)


def cancellation_evidence(requests: DataFrame, accounts: DataFrame, evidence: DataFrame) -> DataFrame:
    names = _names(requests, accounts)
    return with_evidence(names.select("request_id"), evidence_summary(names, evidence))


def gate(decisions: DataFrame, policy: str = "confirm", floor: float = GATE_CONFIDENCE) -> DataFrame:
    """Which actions may go ahead.

    ``confirm`` holds a confident action behind a confirmation; ``auto`` passes it on, unless the
    decision escalates. The id depends only on request and action, so a replay yields it again.
    """
    if policy not in ("confirm", "auto"):
        raise ValueError(f"unknown gate policy: {policy}")
    confident = F.col("action").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= floor)
    if policy == "auto":
        passed = confident & ~F.coalesce("escalate", F.lit(False))
        return decisions.withColumn("execute", passed)
    parts = [F.col("request_id").cast("string"), F.col("action.type"), F.col("action.target")]
    return decisions.withColumns(
        {
            "confirmation_required": confident,
            "confirmation_id": F.when(confident, F.sha2(F.concat_ws("|", *parts), 256)),
        }
    )
