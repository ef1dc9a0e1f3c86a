"""Account, order and ticket sheets to typed rows, with every bad row named.

A sheet is a DataFrame of (row_no, cells): the 1-based sheet row and its cells, trailing empty
cells left out, the header at row 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.functions.rows import computed_once
from casework.functions.scalars import (
    parse_bool,
    parse_fee,
    parse_local_time,
    parse_number,
)
from casework.functions.text import nullable_string, trim_space
from casework.operators.joins import lookup
from casework.schemas import ORDER_STATUSES, PLANS, SNAPSHOT_MARKER, SNAPSHOT_STAMP
from casework.sources.numbering import dense_numbers
from casework.workspace import freeze

PREVIEW_ROWS = 6


class SheetError(ValueError):
    """A sheet that must not be loaded."""


_CSV_CELL = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'
_PLAIN, _START, _QUOTED, _CLOSED = range(4)  # in a bare cell, where one begins, in quotes, after one in quotes


def _open_after(line: Column, quoted: bool) -> Column:
    """Whether a quoted cell is open at the end of ``line``, if one was (not) open before it."""
    def outside(part: Column) -> Column:
        return F.when(part.endswith(","), _START).otherwise(_PLAIN)

    def step(state: Column, part: Column) -> Column:
        """A quote, then ``part`` up to the next quote."""
        return (
            F.when(state.isin(_START, _CLOSED), _QUOTED)
            .when(state == _PLAIN, outside(part))
            .otherwise(F.when(part == "", _CLOSED).otherwise(outside(part))))

    parts = F.split(line, '"', -1)
    first = F.get(parts, F.lit(0))
    begin = F.lit(_QUOTED) if quoted else F.when((first == "") | first.endswith(","), _START).otherwise(_PLAIN)
    state = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, step)
    return F.when(F.contains(line, F.lit('"')), state == _QUOTED).otherwise(quoted)


def _line_states(lines: DataFrame) -> DataFrame:
    """Per line, with no quoted cell open before its block and with one: is one open before and
    after the line, and at which line of the block did its row begin (null: before the block).

    A line takes open or not to open or not. One that ends alike either way settles the state
    after it; between those only the lines that swap count, so running totals of a block are enough.
    """
    block = Window.partitionBy("_file", "_block").orderBy("_pos")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.withColumns({"_end0": _open_after(F.col("_line"), False), "_end1": _open_after(F.col("_line"), True)})
    swaps = ends.withColumn("_swaps", F.coalesce(F.sum(F.when(
        F.col("_end0") & ~F.col("_end1"), 1).otherwise(0)).over(before), F.lit(0)))
    settled = F.when(F.col("_end0") == F.col("_end1"), F.struct(F.col("_end0").alias("open"), F.col("_swaps").alias("swaps")))
    seen = swaps.withColumn("_last", F.last(settled, ignorenulls=True).over(before))
    odd = (F.col("_swaps") - F.coalesce(F.col("_last.swaps"), F.lit(0))) % 2 == 1
    out = seen.select("_file", "_block", "_pos", "_line", "_end0", "_end1", *[
        (F.coalesce(F.col("_last.open"), F.lit(bool(i))) != odd).alias(f"_open{i}") for i in (0, 1)])
    return out.withColumns({f"_row{i}": F.last(F.when(~F.col(f"_open{i}"), F.col("_pos")), ignorenulls=True).over(
        block.rowsBetween(Window.unboundedPreceding, 0)) for i in (0, 1)})


_BEFORE = "_file string, _block long, _was boolean, _row_block long, _row_pos long, _torn_block long, _torn_pos long"


def _before_blocks(spark: SparkSession, states: DataFrame) -> DataFrame:
    """Per block, what lies before it: is a cell open, where did its row begin, and which row of
    the file is never closed. One row a block comes to the driver."""
    def after(i: int) -> Column:
        return F.when(F.col(f"_open{i}"), F.col("_end1")).otherwise(F.col("_end0"))

    blocks = states.groupBy("_file", "_block").agg(*[
        F.struct(F.max_by(after(i), "_pos").alias("open"), F.max(f"_row{i}").alias("row")).alias(f"after{i}") for i in (0, 1)])
    before, torn, now = [], {}, (False, None, None)
    last_file = None
    for b in sorted(blocks.collect(), key=lambda r: (r["_file"], r["_block"])):
        if b["_file"] != last_file:
            last_file, now = b["_file"], (False, None, None)
        before.append((b["_file"], b["_block"], *now))
        after_it = b.after1 if now[0] else b.after0
        now = (after_it.open, *((b["_block"], after_it.row) if after_it.row is not None else now[1:]))
        torn[last_file] = now[1:] if now[0] else (None, None)
    return spark.createDataFrame([(*r, *torn[r[0]]) for r in before], _BEFORE)


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV file(s) without header handling, as (row_no, cells) in file order.

    Every row counts, also a blank one, which has no cells. Cells may be quoted, with doubled quotes
    and line breaks inside; a quote within a bare cell is plain text. All cells are kept, however
    many, but for trailing empty ones; breaks inside a cell read as \\n. A quote never closed takes
    the rest of its file into one row with null ``cells``, which every parser rejects.

    A file's blocks are read apart. Each line is judged both ways, as if a cell were open before its
    block and as if not; one row a block then says which holds. Lines of one row meet by the place
    where it begins; rows of a single line, nearly all, are not moved for that.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        F.regexp_replace("value", "\\r$", "").alias("_line"),
    )
    states = freeze(_line_states(lines), "lines")
    before = F.broadcast(_before_blocks(spark, states))  # one row for each block of a file
    held = states.join(before, ["_file", "_block"])
    began = F.when(F.col("_was"), F.col("_row1")).otherwise(F.col("_row0"))
    is_open = F.when(F.col("_was"), F.col("_open1")).otherwise(F.col("_open0"))
    closes = ~F.when(is_open, F.col("_end1")).otherwise(F.col("_end0"))
    row = F.struct(
        F.when(began.isNull(), F.col("_row_block")).otherwise(F.col("_block")).alias("block"),
        F.coalesce(began, "_row_pos").alias("pos"))
    torn = F.struct(F.col("_torn_block").alias("block"), F.col("_torn_pos").alias("pos"))
    held = held.select(
        "_file", "_block", "_pos", "_line", row.alias("_row"), (~is_open & closes).alias("_single"),
        is_open.alias("_open"), (F.col("_torn_pos").isNotNull() & row.eqNullSafe(torn)).alias("_torn"))
    single = held.where("_single").select("_file", "_row", F.col("_line").alias("_text"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_pos", "_line")))
    several = held.where("NOT _single AND NOT _torn").groupBy("_file", "_row").agg(
        F.array_join(F.transform(parts, lambda p: p["_line"]), "\n").alias("_text"))
    never = held.where("_torn AND NOT _open").select("_file", "_row", F.lit(None).cast("string").alias("_text"))

    found = F.regexp_extract_all("_text", F.lit(_CSV_CELL), F.lit(1))
    plain = F.transform(found, lambda c: F.when(
        c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
        F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(c))
    used = F.array_max(F.transform(plain, lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    cells = F.when(F.col("_text").isNotNull(), F.slice(plain, F.lit(1), F.coalesce(used, F.lit(0))))
    rows = single.union(several).union(never).select("_file", "_row", cells.alias("cells"))
    return dense_numbers(rows, ["_file", "_row.block", "_row.pos"], "row_no").select("row_no", "cells")


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


def _typed_rows(sheet: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Data rows with every cell read once."""
    width = F.coalesce(F.size("cells"), F.lit(-1)).alias("_width")
    rows = sheet.where(F.col("row_no") > 1).select("row_no", "cells", width)
    return computed_once(rows, cells).drop("cells")


def _time_cells(places: dict[str, int]) -> dict[str, Column]:
    out = {}
    for name, i in places.items():
        out[name] = parse_local_time(_cell(i))
        out[f"_no_{name}"] = trim_space(_cell(i)) == ""
    return out


def _bad_time(name: str) -> Column:
    return F.col(name).isNull() & ~F.col(f"_no_{name}")


def _row(name: str, detail: str) -> Column:
    return F.concat(F.lit(f"{name} row "), F.col("row_no").cast("string"), F.lit(detail))


def _width_error(name: str, wanted: int, wording: str) -> Column:
    text = F.concat(
        _row(name, " has "),
        F.col("_width").cast("string"),
        F.lit(f" columns, expected {wording}{wanted}"),
    )
    broken = F.col("_width") < 0  # the size of no array
    return F.when(broken, _row(name, " has an unclosed quote")).when(F.col("_width") < wanted, text)


def _result(rows: DataFrame, reason: Column) -> DataFrame:
    shown = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*shown, reason.alias("reject_reason"))


def parse_accounts(sheet: DataFrame) -> DataFrame:
    """Typed account rows with ``reject_reason`` (null = good)."""
    rows = _typed_rows(
        sheet,
        {
            **{n: _cell(i) for i, n in enumerate(("account_id", "account_name", "plan", "status"))},
            "csm": nullable_string(_cell(4)),
            "contract_file": nullable_string(_cell(5)),
            "premium_support": parse_bool(_cell(6)),
            "notes": nullable_string(_cell(7)),
        },
    )
    reason = (
        _width_error("accounts", 8, "")
        .when(F.col("premium_support").isNull(), _row("accounts", ": invalid premium_support"))
        .when(~F.col("plan").isin(*PLANS), _row("insert account", ": plan is not allowed"))
    )
    return _result(rows, reason)


def parse_orders(sheet: DataFrame) -> DataFrame:
    """Typed order rows with ``reject_reason`` (null = good)."""
    windows = {"booked_at": 4, "pickup_window_start": 5, "pickup_window_end": 6, "pickup_actual_at": 7}
    late = {"cancellation_requested_at": 11}
    rows = _typed_rows(
        sheet,
        {
            **{n: _cell(i) for i, n in enumerate(("order_id", "account_id", "carrier", "status"))},
            **_time_cells(windows),
            "_fee": parse_number(_cell(8)),
            "shipment_fee_inr": parse_fee(_cell(8)),
            "carrier_fault": parse_bool(_cell(9)),
            "customer_fault": parse_bool(_cell(10)),
            **_time_cells(late),
            "notes": nullable_string(_cell(12)),
        },
    )
    reason = _width_error("orders", 13, "")
    for name in (*windows, *late):
        reason = reason.when(_bad_time(name), _row("orders", f" {name}"))
    reason = reason.when(F.col("_fee").isNull(), _row("orders", " shipment_fee_inr"))
    for name in ("carrier_fault", "customer_fault"):
        reason = reason.when(F.col(name).isNull(), _row("orders", f" {name}"))
    reason = reason.when(
        F.col("shipment_fee_inr").isNull(),
        _row("insert order", ": shipment_fee_inr is out of range"),
    ).when(
        ~F.col("status").isin(*ORDER_STATUSES), _row("insert order", ": status is not allowed")
    )
    return _result(rows, reason)


def parse_tickets(sheet: DataFrame) -> DataFrame:
    """Typed ticket rows with ``reject_reason`` (null = good); the tenth cell may be missing."""
    rows = _typed_rows(
        sheet,
        {
            "ticket_id": _cell(0),
            "account_id": _cell(1),
            **_time_cells({"created_at": 2}),
            **{n: _cell(i) for i, n in enumerate(("status", "subject", "description"), 3)},
            "channel": nullable_string(_cell(6)),
            "assigned_to": nullable_string(_cell(7)),
            **_time_cells({"last_customer_message_at": 8}),
            "historical_resolution": nullable_string(_cell(9)),
        },
    )
    reason = _width_error("tickets", 9, "at least ")
    for name in ("created_at", "last_customer_message_at"):
        reason = reason.when(_bad_time(name), _row("tickets", f" {name}"))
    reason = reason.when(
        F.col("created_at").isNull(), _row("insert ticket", ": created_at is required")
    )
    return _result(rows, reason)


def with_known_accounts(parsed: DataFrame, accounts: DataFrame, name: str) -> DataFrame:
    """Parsed orders or tickets, rejected also where their account is not among ``accounts``.

    For either load mode; an earlier reason stays.
    """
    known = accounts.select("account_id", F.lit(True).alias("_known")).distinct()
    missing = F.col("_known").isNull()
    reason = F.coalesce("reject_reason", F.when(missing, _row(f"insert {name}", ": account does not exist")))
    return lookup(parsed, known, "account_id").withColumn("reject_reason", reason).drop("_known")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("row_no", "reject_reason")


def load(parsed: DataFrame, name: str, mode: str = "abort") -> DataFrame:
    """Good rows. ``abort`` raises on the first bad row or an empty sheet; ``quarantine`` keeps
    the good rows and leaves the bad ones to ``rejected``."""
    if mode not in ("abort", "quarantine"):
        raise ValueError(f"unknown load mode: {mode}")
    if mode == "abort":
        bad = F.when(F.col("reject_reason").isNotNull(), F.col("row_no"))
        seen = parsed.agg(F.count("*").alias("rows"), F.min_by("reject_reason", bad).alias("first_bad")).first()
        if not seen.rows:
            raise SheetError(f"{name} sheet contains no data")
        if seen.first_bad is not None:
            raise SheetError(seen.first_bad)
    return accepted(parsed)


def snapshot_gate(
    notes: DataFrame,
    group: list[str] | None = None,
    marker: str = SNAPSHOT_MARKER,
    stamp: str = SNAPSHOT_STAMP,
) -> DataFrame:
    """Per workbook: does every marked line carry the expected stamp, and is there one?"""
    line = F.concat_ws(" ", "cells")
    marked = F.contains(line, F.lit(marker))
    stray = marked & ~F.contains(line, F.lit(stamp))
    found = notes.groupBy(*(group or [])).agg(
        F.count_if(marked).alias("marked_lines"),
        F.min_by(F.when(stray, line), F.when(stray, F.col("row_no"))).alias("_stray"),
    )
    error = F.when(
        F.col("_stray").isNotNull(),
        F.concat(F.lit("unexpected dataset snapshot: "), "_stray"),
    ).when(F.col("marked_lines") == 0, "dataset snapshot not found in README")
    return found.withColumns({"error": error, "ok": error.isNull()}).drop("_stray")


def sheet_preview(sheets: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of each sheet; sheet rows are numbered already, so a filter is enough."""
    return sheets.where(F.col("row_no") <= rows)


def load_counts(parsed: dict[str, DataFrame]) -> DataFrame:
    """Rows loaded per table."""
    out = None
    for name, rows in parsed.items():
        one = rows.where(F.col("reject_reason").isNull()).agg(F.count("*").alias("rows"))
        one = one.select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
