"""Everything known about a request: its account, its order, its account's tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions.text import equal_fold
from casework.operators.joins import lookup
from casework.schemas import SECURITY_SUBJECT
from casework.sources.numbering import dense_numbers

_NOT_FOUND = ": no rows in result set"


def security_tickets(tickets: DataFrame) -> DataFrame:
    """Per account, the newest ticket that reports a possible key exposure."""
    newest = F.max_by("ticket_id", F.struct("created_at", "ticket_id"))
    return (
        tickets.where(equal_fold(F.col("subject"), SECURITY_SUBJECT))
        .groupBy("account_id")
        .agg(newest.alias("security_ticket_id"))
    )


def account_tickets(tickets: DataFrame) -> DataFrame:
    """All tickets with their ``position`` per account, newest first, one row per ticket.

    Requests refer to these rows by account; a copy per request would multiply a busy account's
    requests by its tickets. All tickets are numbered in one range-partitioned order, and an
    account's positions count from its first number: no account has to fit in one task, however
    many tickets it has or how close together they came.
    """
    kept = tickets.select("account_id", "ticket_id", "status", "subject", "created_at")
    order = [F.asc("account_id"), F.desc("created_at"), F.desc("ticket_id")]
    numbered = dense_numbers(kept, order, "_n")
    firsts = numbered.groupBy("account_id").agg(F.min("_n").alias("_first"))
    placed = lookup(numbered, firsts, "account_id")
    return placed.withColumn("position", F.col("_n") - F.col("_first") + 1).select(
        "account_id", "position", "ticket_id", "status", "subject", "created_at"
    )


def request_tickets(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """The ranked tickets of every account that has a request."""
    wanted = requests.select("account_id").distinct()
    return account_tickets(lookup(tickets, wanted, "account_id", "left_semi"))


def request_account(
    requests: DataFrame, accounts: DataFrame, tickets: DataFrame | None = None
) -> DataFrame:
    """Requests with their account; ``account_error`` where there is none.

    Given tickets, also the account's ``security_ticket_id``: accounts take it along before they
    meet the requests, which are then shuffled once for both.
    """
    side = accounts.select(
        "account_id",
        "account_name",
        "plan",
        F.col("status").alias("account_status"),
        "premium_support",
        F.lit(True).alias("_found"),
    )
    if tickets is not None:
        side = side.join(security_tickets(tickets), "account_id", "left")
    joined = lookup(requests, side, "account_id")
    missing = F.concat(F.lit("load account: get account "), "account_id", F.lit(_NOT_FOUND))
    found = F.coalesce("_found", F.lit(False))
    return joined.withColumns(
        {"account_found": found, "account_error": F.when(~found, missing)}
    ).drop("_found")


def request_order(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """Requests with their order. No order id means no order; an unknown one is an error."""
    side = orders.select(
        "order_id",
        F.lit(True).alias("_found"),
        F.col("account_id").alias("order_account_id"),
        F.col("status").alias("order_status"),
        "carrier",
        F.col("shipment_fee_inr").cast("double").alias("shipment_fee"),
        "carrier_fault",
        "customer_fault",
        "pickup_window_end",
        "booked_at",
    )
    given = F.nullif(F.col("order_id"), F.lit(""))
    joined = lookup(requests, side, "order_id", given=given)
    found = F.coalesce("_found", F.lit(False))
    missing = F.concat(F.lit("load order: get order "), "order_id", F.lit(_NOT_FOUND))
    return joined.withColumns(
        {
            "order_found": found,
            "order_error": F.when(given.isNotNull() & ~found, missing),
            "order_account_mismatch": F.col("order_account_id") != F.col("account_id"),
        }
    ).drop("_found")


def request_context(
    requests: DataFrame, accounts: DataFrame, orders: DataFrame, tickets: DataFrame
) -> DataFrame:
    """One wide row per request, with ``error`` where loading stops."""
    context = request_order(request_account(requests, accounts, tickets), orders)
    loading = F.coalesce("account_error", "order_error")
    error = F.when(F.col("query") == "", "query cannot be empty").when(
        loading.isNotNull(), F.concat(F.lit("load structured context: "), loading)
    )
    return context.withColumn("error", error).drop("account_error", "order_error")
