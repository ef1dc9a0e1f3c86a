"""Reports over the audit trail, escalations, documents and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.schemas import CURRENT_DOCUMENT_STATUSES


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """Newest row per key by (created_at, id), as a map-side combined aggregate."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, "_row.*").select(*rows.columns)


def latest_audit(audit: DataFrame) -> DataFrame:
    return _newest(audit, "target_id")


def latest_escalation(escalations: DataFrame, status: str | None = None) -> DataFrame:
    rows = escalations if status is None else escalations.where(F.col("status") == status)
    return _newest(rows, "ticket_id")


def audit_summary(audit: DataFrame) -> DataFrame:
    """Actions by type and status change."""
    return audit.groupBy(
        "action_type",
        F.get_json_object("previous_state", "$.status").alias("previous_status"),
        F.get_json_object("new_state", "$.status").alias("new_status"),
    ).agg(F.count("*").alias("n"))


def authority_rank(documents: DataFrame) -> DataFrame:
    """Documented-only: the leading current document per (account scope, type).

    Lowest rank wins, then the latest start of effect, then the file name.
    """
    current = documents.where(F.col("status").isin(*CURRENT_DOCUMENT_STATUSES))
    since = F.coalesce(
        F.datediff("effective_from", F.lit("0001-01-01").cast("date")), F.lit(-1)
    )
    order = F.struct(F.col("authority_rank"), (-since).alias("since"), F.col("filename"))
    lead = F.min_by(
        F.struct("filename", "title", "status", "authority_rank", "effective_from"), order
    )
    return current.groupBy("account_id", "document_type").agg(lead.alias("_lead")).select(
        "account_id", "document_type", "_lead.*"
    )


def outcome_flags() -> tuple[Column, Column]:
    """Whether a decision is eligible, and whether it is resolved."""
    eligible = F.col("error").isNull()
    resolved = eligible & ~F.col("escalate") & ~F.col("needs_agent")
    return eligible, F.coalesce(resolved, F.lit(False))


def resolution_rate(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Documented-only: share of eligible requests finished without a person.

    Eligible requests loaded without error; resolved ones neither escalate nor need an agent.
    """
    eligible, resolved = outcome_flags()
    counted = decisions.groupBy(*by).agg(
        F.count_if(eligible).alias("eligible"), F.count_if(resolved).alias("resolved")
    )
    return counted.withColumn("rate", F.try_divide(F.col("resolved"), F.col("eligible")))
