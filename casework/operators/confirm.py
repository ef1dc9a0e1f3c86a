"""One-shot confirmations that expire, over whole tables of proposals and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.operators.joins import aggregate_apart, lookup
from casework.schemas import CONFIRMATION_MINUTES

NOT_FOUND = "confirmation not found or expired"


def _expires(created: Column, minutes: int) -> Column:
    return created + F.make_dt_interval(mins=F.lit(minutes))


def _first_answers(proposals: DataFrame, answers: DataFrame) -> DataFrame:
    """Per known id, the answer that spends it: (confirmation_id, first struct).

    An answer before its proposal exists finds nothing and spends nothing.
    """
    created = proposals.select("confirmation_id", "created_at")
    given = answers.select("confirmation_id", "answered_at", "seq", "confirm")
    met = lookup(given, created, "confirmation_id", "inner").where(
        F.col("answered_at") >= F.col("created_at")
    )
    first = F.min(F.struct("answered_at", "seq", "confirm"))
    return aggregate_apart(met, "confirmation_id", _first=first)


def confirmation_outcomes(
    proposals: DataFrame,
    answers: DataFrame,
    minutes: int = CONFIRMATION_MINUTES,
) -> DataFrame:
    """Every answer with its ``status``: executed, rejected, or null with ``error``.

    The first answer spends the id, accept or reject, in time or late; exactly on the expiry
    instant is in time.
    """
    first = _first_answers(proposals, answers)
    spent = first.join(proposals, "confirmation_id").select(
        "confirmation_id", F.col("_first.seq").alias("_seq"),
        _expires(F.col("created_at"), minutes).alias("_expires"),
        "action_type", "target_id", "reason",
    )
    rows = lookup(answers, spent, "confirmation_id")
    won = (F.col("seq") == F.col("_seq")) & (F.col("answered_at") <= F.col("_expires"))
    won = F.coalesce(won, F.lit(False))
    confirmed = won & F.col("confirm")
    return rows.select(
        "confirmation_id", "seq", "answered_at",
        F.when(won, F.when(F.col("confirm"), "executed").otherwise("rejected")).alias("status"),
        F.when(~won, NOT_FOUND).alias("error"),
        *[F.when(confirmed, F.col(c)).alias(c) for c in ("action_type", "target_id", "reason")],
    )


def match_confirmations(
    proposals: DataFrame,
    answers: DataFrame,
    minutes: int = CONFIRMATION_MINUTES,
) -> DataFrame:
    """Every proposal with what became of it: confirmed, rejected or expired."""
    first = _first_answers(proposals, answers)
    joined = proposals.join(first, "confirmation_id", "left")
    in_time = F.col("_first.answered_at") <= _expires(F.col("created_at"), minutes)
    state = (
        F.when(F.coalesce(in_time, F.lit(False)) & F.col("_first.confirm"), "confirmed")
        .when(F.coalesce(in_time, F.lit(False)), "rejected")
        .otherwise("expired")
    )
    return joined.select(
        "confirmation_id", "created_at", F.col("_first.seq").alias("answer_seq"),
        F.col("_first.answered_at").alias("answered_at"), state.alias("state"),
    )
