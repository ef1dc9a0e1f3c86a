"""Typed parsing of sheet cells and the small money and time rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions.text import trim_space
from casework.schemas import (
    CANCELLATION_FEE,
    CREDIT_CAP,
    CREDIT_RATE,
    FREE_CANCELLATION_MINUTES,
    SHEET_TIMEZONE,
)

# fixed values: the accepted spellings of a boolean cell, untrimmed
TRUE_TEXTS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_TEXTS = ("0", "f", "F", "FALSE", "false", "False")

_NUMBER_SHAPE = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def parse_local_time(c: Column, timezone: str = SHEET_TIMEZONE) -> Column:
    """``yyyy-MM-dd HH:mm`` wall time in ``timezone`` to an instant; anything else is null."""
    zoned = F.concat(trim_space(c), F.lit(f" {timezone}"))
    return F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd H:mm VV"))


def bad_local_time(c: Column, timezone: str = SHEET_TIMEZONE) -> Column:
    """True for a cell that is neither blank nor a time."""
    return (trim_space(F.coalesce(c, F.lit(""))) != "") & parse_local_time(c, timezone).isNull()


def parse_bool(c: Column) -> Column:
    """Exactly the accepted spellings; a cast would also take ``yes``."""
    return F.when(c.isin(*TRUE_TEXTS), True).when(c.isin(*FALSE_TEXTS), False)


def parse_number(c: Column) -> Column:
    """Decimal or exponent notation to double, without Java's suffixes; else null."""
    return F.when(c.rlike(_NUMBER_SHAPE), c).try_cast("double")


def parse_fee(c: Column) -> Column:
    """Number text to DECIMAL(12,2), rounding half up; null when unreadable or too wide."""
    return parse_number(c).try_cast("decimal(12,2)")


def credit_amount(fee: Column, rate: float = CREDIT_RATE, cap: float = CREDIT_CAP) -> Column:
    """Share of the fee up to a cap, in double; rounding happens on storage."""
    return F.least(fee.cast("double") * F.lit(rate), F.lit(cap))


def stored_amount(amount: Column) -> Column:
    """The amount as its table keeps it; null when it does not fit or is not positive."""
    stored = amount.try_cast("decimal(12,2)")
    return F.when(stored > 0, stored)


def money_text(amount: Column) -> Column:
    """Two decimals, no grouping, ties decided by the exact binary value."""
    return F.call_function("format_number", amount, F.lit("0.00"))


def past_pickup(requested_at: Column, window_end: Column, hours: int) -> Column:
    """Has the pickup window been over for at least ``hours``? Null when the end is unknown."""
    return requested_at >= window_end + F.make_dt_interval(hours=F.lit(hours))


def delay_minutes(requested_at: Column, window_end: Column) -> Column:
    """Whole minutes between the window end and the request."""
    return F.timestamp_diff("MINUTE", window_end, requested_at)


def cancellation_fee(
    status: Column, booked_at: Column, requested_at: Column, has_agreement: Column
) -> Column:
    """Documented-only fee schedule for cancelling a BOOKED order; null for other states."""
    free_until = booked_at + F.make_dt_interval(mins=F.lit(FREE_CANCELLATION_MINUTES))
    fee = (
        F.when(has_agreement, 0.0)
        .when(booked_at.isNull(), F.lit(None).cast("double"))
        .when(requested_at <= free_until, 0.0)
        .otherwise(CANCELLATION_FEE)
    )
    return F.when(status == "BOOKED", fee)
