import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.functions import payloads
from casework.operators.confirm import NOT_FOUND, confirmation_outcomes, match_confirmations

T0 = dt.datetime(2026, 8, 16, 12)


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture
def sides(spark):
    proposals = spark.createDataFrame([(c, T0, "CANCEL_ORDER", "O1", "r") for c in "ABCDEFG"],
                                      "confirmation_id string, created_at timestamp, action_type string, target_id string, reason string")
    rows = [("A", 1, at(10), True), ("B", 2, at(10, 1), True), ("C", 3, at(1), False), ("C", 4, at(2), True),
            ("D", 5, at(20), True), ("D", 6, at(21), True), ("E", 7, at(-1), True), ("E", 8, at(3), True),
            ("G", 9, at(1), True), ("G", 10, at(1), False), ("Z", 11, at(1), True)]
    return proposals, spark.createDataFrame(rows, "confirmation_id string, seq long, answered_at timestamp, confirm boolean")


def test_every_answer(sides):
    found = {r.seq: (r.status, r.error, r.action_type) for r in confirmation_outcomes(*sides).collect()}
    lost = (None, NOT_FOUND, None)
    assert found == {
        1: ("executed", None, "CANCEL_ORDER"), 2: lost, 3: ("rejected", None, None), 4: lost, 5: lost, 6: lost,
        7: lost, 8: ("executed", None, "CANCEL_ORDER"), 9: ("executed", None, "CANCEL_ORDER"), 10: lost, 11: lost}


def test_every_proposal(sides):
    assert rows_of(match_confirmations(*sides), "confirmation_id", "state") == [
        ("A", "confirmed"), ("B", "expired"), ("C", "rejected"), ("D", "expired"), ("E", "confirmed"),
        ("F", "expired"), ("G", "confirmed")]


INVALID, SINGLE = "invalid JSON body", "request body must contain a single JSON object"


@pytest.mark.parametrize("body, expected", [
    ('{"query":" q ","account_id":"a","order_id":"o","more":[1]}', ("q", "a", "o", None)),
    ('{"Query":"q","ACCOUNT_ID":"a","order_Id":"o"}', ("q", "a", "o", None)),
    ('{"query":"q","account_id":', INVALID), ("", INVALID), ("nonsense", INVALID), (None, INVALID),
    ('["q"]', INVALID), ('"q"', INVALID), ('{"query":5,"account_id":"a","order_id":"o"}', INVALID),
    ('{"query":{"x":1},"account_id":"a","order_id":"o"}', INVALID),
    ('{"query":"q","account_id":"a","order_id":"o"} {}', SINGLE), ('{"query":"q"}]', SINGLE), ('{"query":"q"}}', SINGLE),
    ('{"query":"q"},{"query":"r"}', SINGLE), ('{"query":"q"} x', SINGLE),
    ("null", "query is required"), ("{}", "query is required"), ('{"query":" \\n "}', "query is required"),
    ('{"query":null,"account_id":"a"}', "query is required"), ('{"query":"q","order_id":"o"}', "account_id is required"),
    ('{"query":"q","account_id":"a","order_id":" "}', "order_id is required")])
def test_request_bodies(spark, body, expected):
    row = payloads.validate_requests(spark.createDataFrame([(body,)], "body string")).first()
    wanted = expected if isinstance(expected, tuple) else (None, None, None, expected)
    assert (row.query, row.account_id, row.order_id, row.error) == wanted


def test_request_size_limit(spark):
    body = '{"query":"q","account_id":"a","order_id":"é"}'
    df = spark.createDataFrame([(body,)], "body string")
    size = len(body.encode())
    assert payloads.validate_requests(df, max_bytes=size).first().error is None
    assert payloads.validate_requests(df, max_bytes=size - 1).first().error == INVALID


@pytest.mark.parametrize("body, expected", [
    ('{"confirmation_id":" c ","confirm":true}', ("c", True, None)), ('{"confirmation_id":"c"}', ("c", False, None)),
    ('{"confirmation_id":"c","confirm":null}', ("c", False, None)), ('{"confirmation_id":"c","confirm":"true"}', INVALID),
    ('{"confirm":true}', "confirmation_id is required"), ('{"confirmation_id":"c"} {}', SINGLE)])
def test_confirmation_bodies(spark, body, expected):
    row = payloads.validate_confirmations(spark.createDataFrame([(body,)], "body string")).first()
    wanted = expected if isinstance(expected, tuple) else (None, None, expected)
    assert (row.confirmation_id, row.confirm, row.error) == wanted


def test_metadata_round_trip(spark):
    df = spark.range(1).select(payloads.chunk_metadata_json(F.lit(3)).alias("m"))
    assert df.select(payloads.decode_metadata(F.col("m"))).first()[0] == {"source": "assessment_pdf", "chunk_index": "3"}
    bad = spark.createDataFrame([('{"a"',), ("[1]",), (None,), ("{}",)], "m string")
    assert [r[0] for r in bad.select(payloads.bad_metadata(F.col("m"))).collect()] == [True, True, False, False]
