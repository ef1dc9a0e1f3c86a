"""The batch operators as streams. Sinks are idempotent per micro-batch, so a replay is safe."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from casework.operators.actions import (
    apply_action_sequence,
    audit_rows,
    new_credits,
    new_escalations,
    order_changes,
    orders_after,
)
from casework.operators.confirm import NOT_FOUND
from casework.operators.decide import evaluate_requests, gate
from casework.operators.vectors import Provider, embed_chunks
from casework.schemas import CONFIRMATION_MINUTES, OUTCOMES, VECTOR_WIDTH
from casework.sources.keyed import Keyed, rows_of_keys
from casework.workspace import drop, freeze, scratch


def table_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet file or folder as a file stream. The last character is globbed because a file
    stream takes a folder or a pattern, not the name of a single file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def batch_folder(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def stream_evaluate(
    requests: DataFrame,
    accounts: DataFrame | Keyed,
    orders: DataFrame | Keyed,
    tickets: DataFrame | Keyed,
    evidence_for: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
) -> StreamingQuery:
    """Requests to gated decisions, batch by batch; no state is changed.

    ``evidence_for`` maps a batch of requests to its evidence, by retrieval or from a table. The
    batch is written down first, so its size is known and a small one is broadcast to the tables;
    only the accounts, orders and tickets it names go on. Of tables stored by key (accounts and
    tickets by account_id, orders by order_id) a batch opens the buckets of its own keys only.
    """
    spark = requests.sparkSession

    def decide(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            rows = freeze(batch, "requests")
            known = rows.select("account_id").distinct()
            asked = rows.select("order_id").distinct()
            decided = evaluate_requests(
                rows, freeze(rows_of_keys(accounts, "account_id", known), "accounts"),
                freeze(rows_of_keys(orders, "order_id", asked), "orders"),
                rows_of_keys(tickets, "account_id", known), evidence_for(rows))
            gate(decided).write.mode("overwrite").parquet(batch_folder(sink, batch_id))

    return (
        requests.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def applied_state(
    past: DataFrame, orders: DataFrame, escalations: DataFrame, credits: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, escalations and credits as the logged outcomes leave them."""
    return (
        orders_after(orders, order_changes(past)),
        escalations.select("ticket_id", "status").unionByName(
            new_escalations(past).select("ticket_id", "status")
        ),
        credits.select("order_id", "status").unionByName(
            new_credits(past).select("order_id", "status")
        ),
    )


def read_outcomes(spark: SparkSession, log: str) -> DataFrame:
    """All logged outcomes."""
    rows = spark.read.schema(OUTCOMES).option("basePath", log).parquet(f"{log.rstrip('/')}/batch=*")
    return rows.select(*OUTCOMES.fieldNames())


def _segments(batches: int) -> list[tuple[int, int]]:
    """Ranges of batches, each a power of two long, that make up the first ``batches``."""
    out, low = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            out.append((low, low + (1 << bit)))
            low += 1 << bit
    return out


def _segment_path(log: str, segment: tuple[int, int]) -> str:
    return f"{log.rstrip('/')}/state/from={segment[0]}/to={segment[1]}"


def _read_state(spark: SparkSession, log: str, batches: int) -> DataFrame:
    """Executed outcomes of the first ``batches`` batches, from at most log2 folders."""
    if not batches:
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).parquet(*[_segment_path(log, s) for s in _segments(batches)])


def _write_state(spark: SparkSession, log: str, batch_id: int) -> None:
    """The segment that ends with this batch: its outcomes and the segments it takes in.

    A row is written again each time its segment doubles, so n batches write each row log2(n)
    times at most. Running a batch again writes the same segment again.
    """
    own = spark.read.schema(OUTCOMES).option("basePath", log).parquet(batch_folder(log, batch_id))
    rows = own.where("outcome = 'executed'").select(*OUTCOMES.fieldNames())
    new = _segments(batch_id + 1)[-1]
    for old in _segments(batch_id):
        if old[0] >= new[0]:
            rows = rows.unionByName(spark.read.schema(OUTCOMES).parquet(_segment_path(log, old)))
    rows.coalesce(max(1, (new[1] - new[0]) // 8)).write.mode("overwrite").parquet(_segment_path(log, new))


def _drop_merged(spark: SparkSession, log: str, batch_id: int) -> None:
    """Segments that the batch before still read and this one does not: that batch is committed."""
    for old in set(_segments(max(0, batch_id - 1))) - set(_segments(batch_id)):
        drop(spark, _segment_path(log, old))


def stream_apply(
    actions: DataFrame,
    orders: DataFrame | Keyed,
    tickets: DataFrame | Keyed,
    escalations: DataFrame | Keyed,
    credits: DataFrame | Keyed,
    log: str,
    checkpoint: str,
) -> StreamingQuery:
    """Confirmed actions to a log of outcomes, one folder per micro-batch.

    New orders, escalations, credits and audit rows follow from the log (``applied_state``,
    ``audit_rows``). Only executed outcomes change state; they are also kept in merged segments,
    so batch n reads log2(n) folders, and of those and of the base tables only the batch's own
    targets go on. Of tables stored by key (orders and credits by order_id, tickets and
    escalations by ticket_id) it opens the buckets of its targets only. Outcomes are written before
    their segment, and both depend on the batch and on earlier batches only, so running a batch
    again after a failure writes the same. A segment goes when a batch begins that no longer reads
    it. ``seq`` must grow from batch to batch.
    """
    spark = actions.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        _drop_merged(spark, log, batch_id)
        with scratch(spark):
            rows = freeze(batch, "actions")
            targets = freeze(rows.select("target_id").distinct(), "targets")

            def own(table: DataFrame | Keyed, key: str) -> DataFrame:
                return rows_of_keys(table, key, targets)

            past = freeze(own(_read_state(spark, log, batch_id), "target_id"), "past")
            state = applied_state(
                past, freeze(own(orders, "order_id"), "orders"),
                own(escalations, "ticket_id"), own(credits, "order_id"))
            done = apply_action_sequence(rows, state[0], own(tickets, "ticket_id"), state[1], state[2])
            done.select(*OUTCOMES.fieldNames()).write.mode("overwrite").partitionBy(
                "outcome"
            ).parquet(batch_folder(log, batch_id))
            _write_state(spark, log, batch_id)

    return (
        actions.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def logged_audit(spark: SparkSession, log: str) -> DataFrame:
    return audit_rows(read_outcomes(spark, log))


def stream_embed(
    chunks: DataFrame,
    sink: str,
    checkpoint: str,
    provider: str | Provider = "hash",
    dims: int = VECTOR_WIDTH,
) -> StreamingQuery:
    """Un-embedded chunks to vectors until the backlog is drained."""
    waiting = chunks.where(F.col("embedding").isNull()).drop("embedding")
    vectors = embed_chunks(waiting, "content", provider, dims)
    return (
        vectors.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def confirmation_stream(
    proposals: DataFrame,
    answers: DataFrame,
    *,
    lateness_minutes: int,
    minutes: int = CONFIRMATION_MINUTES,
) -> DataFrame:
    """Proposals and answers as streams to one row per proposal and per answer that found none.

    ``status`` is executed or rejected by the first answer in time, expired for a proposal nobody
    answered in time, and null with ``error`` for an answer that is late, early or to an unknown
    id. First means by (answered_at, seq), whatever the order of arrival; an answer in time that
    is not the first vanishes. So the rows are those of ``confirmation_outcomes`` less the latter.

    Answers meet their proposal within its interval, and a minimum per proposal closes when the
    watermark has passed the interval; nothing is decided before. Rows more than
    ``lateness_minutes`` behind the latest are dropped, as by any watermark; ``stream_replies`` has
    a row for each of them, and for answers that came second.
    """
    ttl = F.lit(timedelta(minutes=minutes))  # a literal, from which Spark bounds the join's state
    left = proposals.withWatermark("created_at", f"{lateness_minutes} minutes").withColumnRenamed(
        "confirmation_id", "_proposed"
    )
    right = answers.withWatermark("answered_at", f"{lateness_minutes} minutes")
    on = (
        (F.col("_proposed") == F.col("confirmation_id"))
        & (F.col("answered_at") >= F.col("created_at"))
        & (F.col("answered_at") <= F.col("created_at") + ttl)
    )
    answer = F.when(
        F.col("confirmation_id").isNotNull(), F.struct("answered_at", "seq", "confirm")
    )
    carried = ("action_type", "target_id", "reason")
    decided = (
        left.join(right, on, "left_outer")
        .groupBy("_proposed", "created_at")
        .agg(F.min(answer).alias("_first"), *[F.max(c).alias(c) for c in carried])
    )
    status = F.when(F.col("_first").isNull(), "expired").when(
        F.col("_first.confirm"), "executed"
    ).otherwise("rejected")
    settled = decided.select(
        F.col("_proposed").alias("confirmation_id"), "_first.seq", "created_at",
        "_first.answered_at", status.alias("status"), F.lit(None).cast("string").alias("error"),
        *carried,
    )
    none = F.lit(None)
    alone = right.join(left, on, "left_outer").where(F.col("_proposed").isNull()).select(
        "confirmation_id", "seq", none.cast("timestamp").alias("created_at"), "answered_at",
        none.cast("string").alias("status"), F.lit(NOT_FOUND).alias("error"),
        *[none.cast("string").alias(c) for c in carried],
    )
    return settled.unionByName(alone)
