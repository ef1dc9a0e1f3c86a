"""Integrity checks that report (rule, key) rows instead of refusing a write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.schemas import (
    ACTIVE_CREDIT_STATUSES,
    CREDIT_STATUSES,
    ESCALATION_PRIORITIES,
    ESCALATION_STATUSES,
    ORDER_STATUSES,
    PLANS,
    VECTOR_WIDTH,
)

# fixed values: (table, key columns), (table, columns that must be present),
# (table, column, parent table, parent column), (table, column, allowed values)
UNIQUE_KEYS = (
    ("accounts", ("account_id",)),
    ("orders", ("order_id",)),
    ("tickets", ("ticket_id",)),
    ("documents", ("id",)),
    ("documents", ("filename",)),
    ("document_chunks", ("id",)),
    ("document_chunks", ("document_id", "chunk_index")),
    ("escalations", ("id",)),
    ("audit_logs", ("id",)),
    ("service_credits", ("id",)),
)
REQUIRED = (
    ("accounts", ("account_id", "account_name", "plan", "status", "premium_support")),
    ("orders", ("order_id", "account_id", "carrier", "status", "shipment_fee_inr",
                "carrier_fault", "customer_fault")),
    ("tickets", ("ticket_id", "account_id", "created_at", "status", "subject", "description")),
    ("documents", ("filename", "title", "document_type", "status", "authority_rank", "metadata")),
    ("document_chunks", ("document_id", "chunk_index", "content", "metadata")),
    ("escalations", ("ticket_id", "account_id", "reason", "priority", "status")),
    ("audit_logs", ("account_id", "action_type", "target_id", "reason")),
    ("service_credits", ("order_id", "account_id", "amount_inr", "reason", "status",
                         "requested_by")),
)
REFERENCES = (
    ("orders", "account_id", "accounts", "account_id"),
    ("tickets", "account_id", "accounts", "account_id"),
    ("documents", "account_id", "accounts", "account_id"),
    ("document_chunks", "document_id", "documents", "id"),
    ("escalations", "ticket_id", "tickets", "ticket_id"),
    ("escalations", "account_id", "accounts", "account_id"),
    ("audit_logs", "account_id", "accounts", "account_id"),
    ("service_credits", "order_id", "orders", "order_id"),
    ("service_credits", "account_id", "accounts", "account_id"),
)
ENUMS = (
    ("accounts", "plan", PLANS),
    ("orders", "status", ORDER_STATUSES),
    ("escalations", "priority", ESCALATION_PRIORITIES),
    ("escalations", "status", ESCALATION_STATUSES),
    ("service_credits", "status", CREDIT_STATUSES),
)
ROW_KEYS = {
    "accounts": "account_id", "orders": "order_id", "tickets": "ticket_id", "documents": "filename",
    "document_chunks": "id", "escalations": "id", "audit_logs": "id", "service_credits": "id",
}
PARENTS = 1 << 18  # keys that a task holds

Tables = dict[str, DataFrame]


def _key(columns) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _report(rows: DataFrame, rule: str, key: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.alias("key"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _failing(rows: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Several row rules in one pass over the table."""
    hits = F.filter(
        F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]),
        lambda r: r.isNotNull(),
    )
    key = F.coalesce(F.col(ROW_KEYS[table]).cast("string"), F.lit(""))
    return rows.select(F.explode(hits).alias("rule"), key.alias("key"))


def check_unique(tables: Tables) -> DataFrame:
    parts = []
    for table, columns in UNIQUE_KEYS:
        if table in tables:
            repeated = tables[table].groupBy(*columns).count().where(F.col("count") > 1)
            parts.append(_report(repeated, f"{table}.{'+'.join(columns)} unique", _key(columns)))
    return _union(parts)


def check_not_null(tables: Tables) -> DataFrame:
    parts = []
    for table, columns in REQUIRED:
        if table in tables:
            rules = {f"{table}.{c} not null": F.col(c).isNull() for c in columns}
            parts.append(_failing(tables[table], table, rules))
    return _union(parts)


def check_foreign_keys(tables: Tables) -> DataFrame:
    """Rows whose parent is missing; null references are left alone.

    All references are stacked as (parent table, value), so each table is read once for its rows
    and once for its keys, and one join answers for every rule. A task hashes the parent keys of its
    partition and streams the rows past them, where a sort would hold the rows, all those of a busy
    parent among them. Partitions are as many as the parents need: adaptive execution would merge
    them by their compressed size, and keys so alike are many times that in memory.
    """
    used = [r for r in REFERENCES if r[0] in tables and r[2] in tables]
    number = {parent: i for i, parent in enumerate(dict.fromkeys(r[2] for r in used))}
    children, parents = [], []
    for table in dict.fromkeys(r[0] for r in used):
        held = F.array(*[
            F.struct(F.lit(f"{table}.{column} references {parent}").alias("rule"),
                     F.struct(F.lit(number[parent]).alias("table"), F.col(column).cast("string").alias("value")).alias("ref"))
            for t, column, parent, _ in used if t == table])
        rows = tables[table].select(
            F.col(ROW_KEYS[table]).cast("string").alias("key"), F.explode(held).alias("r"))
        children.append(rows.select("key", "r.rule", "r.ref").where(F.col("ref.value").isNotNull()))
    for parent, column in dict.fromkeys((r[2], r[3]) for r in used):
        ref = F.struct(F.lit(number[parent]).alias("table"), F.col(column).cast("string").alias("value"))
        parents.append(tables[parent].select(ref.alias("ref")))
    known = _union(parents).where(F.col("ref.value").isNotNull())
    n = max(known.sparkSession.sparkContext.defaultParallelism, known.count() // PARENTS + 1)
    known = known.select(F.col("ref").alias("known")).repartition(n, "known").distinct().hint("shuffle_hash")
    rows = _union(children).repartition(n, "ref")
    # An anti-join would be pushed below the repartition, into every part of the union.
    return rows.join(known, F.col("ref") == F.col("known"), "left").where("known IS NULL").select("rule", "key")


def check_enums(tables: Tables) -> DataFrame:
    parts = []
    for table in dict.fromkeys(t for t, _, _ in ENUMS):
        if table in tables:
            rules = {
                f"{t}.{c} allowed": ~F.col(c).isin(*values)
                for t, c, values in ENUMS if t == table
            }
            parts.append(_failing(tables[table], table, rules))
    return _union(parts)


def check_active_unique(escalations: DataFrame, credits: DataFrame) -> DataFrame:
    created = escalations.where(F.col("status") == "created").groupBy("ticket_id").count()
    active = credits.where(F.col("status").isin(*ACTIVE_CREDIT_STATUSES)).groupBy("order_id").count()
    more = F.col("count") > 1
    return _report(
        created.where(more), "one created escalation per ticket", F.col("ticket_id")
    ).unionByName(
        _report(active.where(more), "one active credit per order", F.col("order_id"))
    )


def check_amount(credits: DataFrame) -> DataFrame:
    bad = credits.where(F.col("amount_inr") <= 0)
    return _report(bad, "service_credits.amount_inr positive", F.col("id").cast("string"))


def check_vector_width(chunks: DataFrame, id_col: str, dims: int = VECTOR_WIDTH) -> DataFrame:
    bad = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != dims))
    return _report(bad, f"embedding has {dims} values", F.col(id_col).cast("string"))


def violations(tables: Tables) -> DataFrame:
    """The table-wide rules together."""
    return _union([check_unique(tables), check_not_null(tables), check_foreign_keys(tables),
                   check_enums(tables)])
