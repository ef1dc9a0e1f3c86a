"""JSON in and out: request bodies, confirmation bodies, chunk metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.rows import computed_once
from casework.functions.text import trim_space
from casework.schemas import CONFIRM_BODY_BYTES, DOCUMENT_SOURCE, EVALUATE_BODY_BYTES

_INVALID = "invalid JSON body"
_NOT_SINGLE = "request body must contain a single JSON object"


def _single_value(body: Column) -> Column:
    """Does the body hold exactly one JSON value?

    The parser stops after the first value. Trailing content cannot be valid both inside an array
    and inside an object, so wrapping the body both ways exposes it.
    """
    in_array = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>"
    )
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    return F.coalesce(F.size(in_array) == 1, F.lit(False)) & in_object.isNotNull()


def _field(members: Column, name: str) -> Column:
    """A member by name, ignoring case but preferring the exact spelling."""
    loose = F.map_values(F.map_filter(members, lambda k, _: F.lower(k) == name))
    return F.coalesce(F.try_element_at(members, F.lit(name)), F.get(loose, F.lit(0)))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _wrong_kind(value: Column, kind: str) -> Column:
    return ~_kind(value).isin(kind, "VOID")


def _with_members(lines: DataFrame, body: str, names: list[str]) -> DataFrame:
    parsed = lines.withColumn("_doc", F.try_parse_json(F.col(body)))
    parsed = parsed.withColumn(
        "_members", F.try_variant_get("_doc", "$", "map<string,variant>")
    )
    return parsed.withColumns({f"_{n}": _field(F.col("_members"), n) for n in names})


def _text(name: str) -> Column:
    value = F.try_variant_get(F.col(f"_{name}"), "$", "string")
    return trim_space(F.coalesce(value, F.lit("")))


def _undecodable(body: str, max_bytes: int, typed: dict[str, str]) -> Column:
    """Too long, not JSON, not an object (``null`` counts as an empty one) or a wrong type."""
    kind = F.schema_of_variant("_doc")
    bad = F.col(body).isNull() | (F.octet_length(body) > max_bytes) | F.col("_doc").isNull()
    bad = bad | ~(kind.startswith("OBJECT") | (kind == "VOID"))
    for name, wanted in typed.items():
        bad = bad | _wrong_kind(F.col(f"_{name}"), wanted)
    return F.coalesce(bad, F.lit(True))


def validate_requests(
    lines: DataFrame, body: str = "body", max_bytes: int = EVALUATE_BODY_BYTES
) -> DataFrame:
    """Adds query, account_id, order_id and ``error`` (null = accepted)."""
    names = ["query", "account_id", "order_id"]
    rows = computed_once(
        _with_members(lines, body, names),
        {
            **{f"_t_{n}": _text(n) for n in names},
            "_bad": _undecodable(body, max_bytes, dict.fromkeys(names, "STRING")),
            "_single": _single_value(F.col(body)),
        },
    )
    error = F.when(F.col("_bad"), _INVALID).when(~F.col("_single"), _NOT_SINGLE)
    for n in names:
        error = error.when(F.col(f"_t_{n}") == "", f"{n} is required")
    rows = rows.withColumn("error", error)
    accepted = F.col("error").isNull()
    return rows.select(
        *lines.columns, *[F.when(accepted, F.col(f"_t_{n}")).alias(n) for n in names], "error"
    )


def validate_confirmations(
    lines: DataFrame, body: str = "body", max_bytes: int = CONFIRM_BODY_BYTES
) -> DataFrame:
    """Adds confirmation_id, confirm and ``error``; an absent ``confirm`` is a rejection."""
    answer = F.try_variant_get("_confirm", "$", "boolean")
    rows = computed_once(
        _with_members(lines, body, ["confirmation_id", "confirm"]),
        {
            "_t_id": _text("confirmation_id"),
            "_answer": F.coalesce(answer, F.lit(False)),
            "_bad": _undecodable(
                body, max_bytes, {"confirmation_id": "STRING", "confirm": "BOOLEAN"}
            ),
            "_single": _single_value(F.col(body)),
        },
    )
    error = (
        F.when(F.col("_bad"), _INVALID)
        .when(~F.col("_single"), _NOT_SINGLE)
        .when(F.col("_t_id") == "", "confirmation_id is required")
    )
    rows = rows.withColumn("error", error)
    accepted = F.col("error").isNull()
    return rows.select(
        *lines.columns,
        F.when(accepted, F.col("_t_id")).alias("confirmation_id"),
        F.when(accepted, F.col("_answer")).alias("confirm"),
        "error",
    )


def chunk_metadata_json(chunk_index: Column, source: str = DOCUMENT_SOURCE) -> Column:
    return F.to_json(F.struct(F.lit(source).alias("source"), chunk_index.alias("chunk_index")))


def document_metadata_json(source: str = DOCUMENT_SOURCE) -> Column:
    return F.to_json(F.struct(F.lit(source).alias("source")))


def decode_metadata(metadata: Column) -> Column:
    """JSON object to map; null for text that is not an object."""
    return F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,string>")


def bad_metadata(metadata: Column) -> Column:
    return metadata.isNotNull() & decode_metadata(metadata).isNull()
