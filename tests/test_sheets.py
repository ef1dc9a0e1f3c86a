import csv
import datetime as dt
import decimal
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.functions import scalars
from casework.schemas import SHEET
from casework.sources import sheets


def sheet(spark, *rows):
    return spark.createDataFrame([(1, ["header"])] + [(i + 2, r) for i, r in enumerate(rows)], SHEET)


ACCOUNT = ["A1", "Harbor", "Growth", "Active", " ann ", "", "TRUE", "  "]
ORDER = ["O1", "A1", "Fast", "BOOKED", "2026-08-16 11:00", "", "2026-08-16 9:05", " ", "12.345", "1", "0", "", " n "]
TICKET = ["T1", "A1", "2026-08-16 11:00", "open", "s", "d", "", "", ""]


def test_account_values(spark):
    row = sheets.load(sheets.parse_accounts(sheet(spark, ACCOUNT)), "accounts").first()
    assert (row.csm, row.contract_file, row.premium_support, row.notes) == ("ann", None, True, None)


def test_order_values(spark):
    row = sheets.load(sheets.parse_orders(sheet(spark, ORDER)), "orders").first()
    assert row.booked_at == dt.datetime(2026, 8, 16, 5, 30)
    assert row.pickup_window_end == dt.datetime(2026, 8, 16, 3, 35)
    assert row.shipment_fee_inr == decimal.Decimal("12.35")
    assert (row.pickup_window_start, row.pickup_actual_at, row.notes) == (None, None, "n")


def test_ticket_tenth_cell_is_optional(spark):
    parsed = sheets.parse_tickets(sheet(spark, TICKET, TICKET + [" done "]))
    assert rows_of(sheets.accepted(parsed), "historical_resolution") == [("done",), (None,)]


def change(row, i, value):
    return row[:i] + [value] + row[i + 1 :]


@pytest.mark.parametrize(
    "parse, row, reason",
    [
        (sheets.parse_accounts, ACCOUNT[:7], "accounts row 2 has 7 columns, expected 8"),
        (sheets.parse_accounts, change(ACCOUNT, 6, "yes"), "accounts row 2: invalid premium_support"),
        (sheets.parse_accounts, change(ACCOUNT, 6, " true"), "accounts row 2: invalid premium_support"),
        (sheets.parse_accounts, change(ACCOUNT, 2, "Gold"), "insert account row 2: plan is not allowed"),
        (sheets.parse_orders, ORDER[:12], "orders row 2 has 12 columns, expected 13"),
        (sheets.parse_orders, change(ORDER, 4, "2026-02-30 10:00"), "orders row 2 booked_at"),
        (sheets.parse_orders, change(change(ORDER, 11, "x"), 8, "x"), "orders row 2 cancellation_requested_at"),
        (sheets.parse_orders, change(ORDER, 8, "1f"), "orders row 2 shipment_fee_inr"),
        (sheets.parse_orders, change(ORDER, 8, " 1"), "orders row 2 shipment_fee_inr"),
        (sheets.parse_orders, change(ORDER, 8, "1e11"), "insert order row 2: shipment_fee_inr is out of range"),
        (sheets.parse_orders, change(ORDER, 10, ""), "orders row 2 customer_fault"),
        (sheets.parse_tickets, TICKET[:8], "tickets row 2 has 8 columns, expected at least 9"),
        (sheets.parse_tickets, change(TICKET, 8, "now"), "tickets row 2 last_customer_message_at"),
        (sheets.parse_tickets, change(TICKET, 2, " "), "insert ticket row 2: created_at is required"),
    ],
)
def test_bad_rows_are_named(spark, parse, row, reason):
    parsed = parse(sheet(spark, row))
    assert rows_of(sheets.rejected(parsed)) == [(2, reason)]
    with pytest.raises(sheets.SheetError, match=reason.split(":")[0]):
        sheets.load(parsed, "sheet")
    assert sheets.load(parsed, "sheet", "quarantine").isEmpty()


def test_abort_names_the_first_bad_row(spark):
    parsed = sheets.parse_accounts(sheet(spark, ACCOUNT, ACCOUNT[:3], ACCOUNT[:2]))
    with pytest.raises(sheets.SheetError, match="row 3 has 3"):
        sheets.load(parsed, "accounts")


def test_sheet_without_data(spark):
    with pytest.raises(sheets.SheetError, match="tickets sheet contains no data"):
        sheets.load(sheets.parse_tickets(sheet(spark)), "tickets")
    with pytest.raises(ValueError):
        sheets.load(sheets.parse_tickets(sheet(spark)), "tickets", "maybe")


def test_csv_sheet_keeps_file_order_and_drops_trailing_blanks(spark, tmp_path):
    lines = ["account_id,name,x"] + [f"A{i}, n{i} ," for i in range(500)]
    (tmp_path / "accounts.csv").write_text("\n".join(lines))
    rows = rows_of(sheets.read_sheet_csv(spark, str(tmp_path / "accounts.csv")))
    assert len(rows) == 501
    assert rows[0] == (1, ["account_id", "name", "x"])
    assert dict(rows)[42] == ["A40", " n40 "]


def test_csv_sheet_loses_no_row_and_no_cell(spark, tmp_path):
    lines = ["a,b,c", "A1,x,TRUE", "", 'A2,"q, ""r""",yes,more,,', 'A3,"two', 'lines",f', "\"\"", 'A4,5" pipe,x', "last\r"]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    rows = dict(rows_of(sheets.read_sheet_csv(spark, str(tmp_path / "s.csv"))))
    assert rows == {1: ["a", "b", "c"], 2: ["A1", "x", "TRUE"], 3: [], 4: ["A2", 'q, "r"', "yes", "more"],
                    5: ["A3", "two\nlines", "f"], 6: [], 7: ["A4", '5" pipe', "x"], 8: ["last"]}
    parsed = sheets.parse_accounts(sheets.read_sheet_csv(spark, str(tmp_path / "s.csv")))
    reasons = dict(rows_of(sheets.rejected(parsed)))
    assert reasons[3] == "accounts row 3 has 0 columns, expected 8" and len(reasons) == 7


def test_lines_of_a_cell_are_no_rows_of_their_own(spark, tmp_path):
    note = '"line one\nB2,Evil,Enterprise,Active,,,true,x\nline ""three"""'
    lines = ["h", f"A1,Real,Growth,Active,,,true,{note}", "A3,After,Growth,Active,,,true,plain"]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    parsed = sheets.parse_accounts(sheets.read_sheet_csv(spark, str(tmp_path / "s.csv")))
    assert rows_of(sheets.accepted(parsed), "row_no", "account_id", "notes") == [
        (2, "A1", 'line one\nB2,Evil,Enterprise,Active,,,true,x\nline "three"'), (3, "A3", "plain")]


def test_a_quote_never_closed_takes_its_file_only(spark, tmp_path):
    (tmp_path / "1.csv").write_text('h\nA1,"open\nA2,x\nA3,y\n')
    (tmp_path / "2.csv").write_text('A4,"z\nz"\n"')
    rows = dict(rows_of(sheets.read_sheet_csv(spark, str(tmp_path))))
    assert rows == {1: ["h"], 2: None, 3: ["A4", "z\nz"], 4: None}
    reasons = dict(rows_of(sheets.rejected(sheets.parse_accounts(sheets.read_sheet_csv(spark, str(tmp_path))))))
    assert reasons[2] == "accounts row 2 has an unclosed quote"
    (tmp_path / "empty.csv").write_text("")
    assert sheets.read_sheet_csv(spark, str(tmp_path / "empty.csv")).count() == 0


@pytest.mark.parametrize("block", ["64b", "300b", "128m"])
def test_csv_in_any_split_reads_like_the_csv_module(spark, settings, tmp_path, block):
    rng = random.Random(block)
    rows = [[str(i), *("".join(rng.choice('ab,"\n') for _ in range(rng.choice([0, 2, 9, 40]))) for _ in range(3)), "z"]
            for i in range(120)]
    with open(tmp_path / "s.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    settings(spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="1b")
    found = sorted(rows_of(sheets.read_sheet_csv(spark, str(tmp_path / "s.csv"))))
    assert found == [(i, r) for i, r in enumerate(rows, 1)]


@pytest.mark.parametrize(
    "lines, ok, error",
    [
        ([["Dataset snapshot", "2026-08-16 11:00 IST"]], True, None),
        ([["Dataset"], ["snapshot"]], False, "dataset snapshot not found in README"),
        ([["Dataset", "snapshot"]], False, "unexpected dataset snapshot: Dataset snapshot"),
        ([["Dataset snapshot", "2026-08-16 11:00"], ["Dataset snapshot old"]], False, "unexpected dataset snapshot: Dataset snapshot old"),
    ],
)
def test_snapshot_gate(spark, lines, ok, error):
    notes = spark.createDataFrame(list(enumerate(lines)), SHEET)
    row = sheets.snapshot_gate(notes).first()
    assert (row.ok, row.error) == (ok, error)


def test_parse_bool_takes_only_the_listed_spellings(spark):
    texts = ["1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False", "yes", "tRUE", "", " 1"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r[0] for r in df.select(scalars.parse_bool(F.col("c"))).collect()] == [True] * 6 + [False] * 6 + [None] * 4


def test_money_rounds_like_binary_on_ties(spark):
    values = [0.125, 0.375, 1.005, 2.675, 1234567.891, 0.004, 120.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(scalars.money_text(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]


def test_stored_amount_rounds_half_up_and_must_be_positive(spark):
    df = spark.createDataFrame([(1.005,), (0.004,), (0.005,), (-1.0,), (1e12,)], "v double")
    found = [r[0] for r in df.select(scalars.stored_amount(F.col("v"))).collect()]
    assert found == [decimal.Decimal("1.01"), None, decimal.Decimal("0.01"), None, None]


def test_cancellation_fee(spark):
    t = dt.datetime(2026, 1, 1)
    cases = [
        ("BOOKED", t, t + dt.timedelta(minutes=30), False, 0.0),
        ("BOOKED", t, t + dt.timedelta(minutes=31), False, 250.0),
        ("BOOKED", t, t + dt.timedelta(days=3), True, 0.0),
        ("PICKED_UP", t, t, True, None),
    ]
    df = spark.createDataFrame(cases, "status string, b timestamp, r timestamp, a boolean, fee double")
    fee = scalars.cancellation_fee(*[F.col(c) for c in ("status", "b", "r", "a")])
    assert [r[0] for r in df.select(fee).collect()] == [c[4] for c in cases]
