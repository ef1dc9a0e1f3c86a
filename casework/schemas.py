"""Table schemas and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
PLANS = ("Standard", "Growth", "Enterprise")
ORDER_STATUSES = ("DRAFT", "BOOKED", "PICKED_UP", "RETURN_TO_ORIGIN", "DELIVERED", "CANCELLED")
ESCALATION_PRIORITIES = ("P1", "P2", "P3")
ESCALATION_STATUSES = ("pending", "confirmed", "created", "cancelled")
CREDIT_STATUSES = ("PENDING_APPROVAL", "APPROVED", "ISSUED", "REJECTED")
ACTIVE_CREDIT_STATUSES = ("PENDING_APPROVAL", "APPROVED", "ISSUED")
CURRENT_DOCUMENT_STATUSES = ("CURRENT", "ACTIVE")

SECURITY_SUBJECT = "Possible API key exposure"
AGREEMENT_PHRASES = ("may cancel any booked shipment", "before pickup", "no cancellation fee")
DENY_PHRASES = ("cannot cancel", "may not cancel", "cancellation is not permitted")
POLICY_PHRASES = ("booked, not yet picked_up", "may be cancelled")
CREDIT_OVERRIDE_PHRASES = (
    "fixed inr 300 service credit",
    "more than 4 hours past the end",
    "carrier is at fault",
)

SHEET_TIMEZONE = "Asia/Kolkata"
SNAPSHOT_MARKER = "Dataset snapshot"
SNAPSHOT_STAMP = "2026-08-16 11:00"
DOCUMENT_SOURCE = "assessment_pdf"

CHUNK_BYTES = 1200
VECTOR_WIDTH = 768
RETRIEVAL_DEPTH = 5
EMBEDDING_BATCH = 8
MIN_AGREEMENT_SCORE = 0.60
AGREEMENT_CONFIDENCE = 0.95
GATE_CONFIDENCE = 0.90
CREDIT_RATE = 0.10
CREDIT_CAP = 500.0
CREDIT_APPROVAL_LIMIT = 1000.0
OVERRIDE_CREDIT = 300.0
DELAY_HOURS = 2
OVERRIDE_DELAY_HOURS = 4
CONFIRMATION_MINUTES = 10
EVALUATE_BODY_BYTES = 1 << 20
CONFIRM_BODY_BYTES = 64 << 10
CANCELLATION_FEE = 250.0
FREE_CANCELLATION_MINUTES = 30
# ----------------------------------------------------------------------------


_TYPES = {
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "DECIMAL(12,2)": T.DecimalType(12, 2),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(*fields: str) -> T.StructType:
    named = [f.split(" ", 1) for f in fields]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


ACCOUNTS = _schema(
    "account_id STRING", "account_name STRING", "plan STRING", "status STRING", "csm STRING",
    "contract_file STRING", "premium_support BOOLEAN", "notes STRING",
    "created_at TIMESTAMP", "updated_at TIMESTAMP",
)
ORDERS = _schema(
    "order_id STRING", "account_id STRING", "carrier STRING", "status STRING",
    "booked_at TIMESTAMP", "pickup_window_start TIMESTAMP", "pickup_window_end TIMESTAMP",
    "pickup_actual_at TIMESTAMP", "shipment_fee_inr DECIMAL(12,2)", "carrier_fault BOOLEAN",
    "customer_fault BOOLEAN", "cancellation_requested_at TIMESTAMP", "notes STRING",
    "created_at TIMESTAMP", "updated_at TIMESTAMP",
)
TICKETS = _schema(
    "ticket_id STRING", "account_id STRING", "created_at TIMESTAMP", "status STRING",
    "subject STRING", "description STRING", "channel STRING", "assigned_to STRING",
    "last_customer_message_at TIMESTAMP", "historical_resolution STRING",
    "created_record_at TIMESTAMP", "updated_at TIMESTAMP",
)
OUTCOMES = _schema(
    "seq BIGINT", "action_type STRING", "target_id STRING", "reason STRING",
    "acted_at TIMESTAMP", "account_id STRING", "status_before STRING", "amount DOUBLE",
    "outcome STRING", "error STRING",
)
SHEET = _schema("row_no BIGINT", "cells ARRAY<STRING>")
