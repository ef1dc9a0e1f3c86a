"""What one evidence chunk says about an account."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.schemas import (
    AGREEMENT_PHRASES,
    CREDIT_OVERRIDE_PHRASES,
    DENY_PHRASES,
    POLICY_PHRASES,
)


def _all_of(text: Column, phrases) -> Column:
    return reduce(and_, [F.contains(text, F.lit(p)) for p in phrases])


def _any_of(text: Column, phrases) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def phrase_flags(text: Column, account_name: Column) -> dict[str, Column]:
    """Four booleans per chunk, given its text after ``normalize_match_text``.

    The name is lower-cased but its own white space is left alone, so a name with doubled blanks
    never matches normalised content, and an empty name matches every chunk. The text is used
    many times: have it as a column of its own, or it is normalised again for every phrase.
    """
    named = F.contains(text, F.lower(account_name))
    return {
        "is_agreement": named & _all_of(text, AGREEMENT_PHRASES),
        "is_deny": named & _any_of(text, DENY_PHRASES),
        "is_policy": _all_of(text, POLICY_PHRASES),
        "is_credit_override": named & _all_of(text, CREDIT_OVERRIDE_PHRASES),
    }
