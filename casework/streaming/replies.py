"""Confirmations as a stream in which every answer gets its reply.

State is a table of what is still open: proposals whose interval the clock has not passed, and the
answers that wait for them. It is written anew by every micro-batch, so it never holds more than the
interval and the allowed lateness together bring in, however long the stream runs.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casework.operators.confirm import NOT_FOUND, confirmation_outcomes, match_confirmations
from casework.operators.joins import lookup
from casework.schemas import CONFIRMATION_MINUTES
from casework.streaming.flows import batch_folder
from casework.workspace import drop, freeze, scratch

EVENTS = ("confirmation_id string, kind string, at timestamp, seq long, confirm boolean, "
          "action_type string, target_id string, reason string")
_PARTS = ("replies", "proposals", "late", "open", "clock")


def _events(proposals: DataFrame, answers: DataFrame) -> DataFrame:
    def shaped(rows: DataFrame, kind: str, at: str) -> DataFrame:
        given = {"kind": F.lit(kind), "at": F.col(at)}
        out = []
        for field in EVENTS.split(", "):
            name, type_ = field.split(" ")
            value = given.get(name, F.col(name) if name in rows.columns else F.lit(None))
            out.append(value.cast(type_).alias(name))
        return rows.select(*out)

    return shaped(proposals, "proposal", "created_at").unionByName(shaped(answers, "answer", "answered_at"))


def _proposals(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'proposal'").select(
        "confirmation_id", F.col("at").alias("created_at"), "action_type", "target_id", "reason")


def _answers(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'answer'").select("confirmation_id", "seq", F.col("at").alias("answered_at"), "confirm")


def _latest(spark: SparkSession, sink: str, batch_id: int) -> datetime | None:
    """The latest event time of the batches before this one."""
    if not batch_id:
        return None
    return spark.read.parquet(batch_folder(f"{sink}/clock", batch_id - 1)).first().latest


def stream_replies(
    proposals: DataFrame,
    answers: DataFrame,
    sink: str,
    checkpoint: str,
    lateness_minutes: int,
    minutes: int = CONFIRMATION_MINUTES,
) -> StreamingQuery:
    """Proposals and answers as streams to one reply per answer, as ``confirmation_outcomes`` has it.

    ``sink/replies`` holds every answer with its status or error, ``sink/proposals`` what became of
    each proposal (``match_confirmations``), ``sink/late`` the rows that came more than
    ``lateness_minutes`` behind the latest one of the batches before. A late answer is replied to as
    one that found nothing; a late proposal is not taken up. Nothing is dropped without a row.

    The clock is the latest event time less the lateness. A proposal is settled once the clock has
    passed its interval, with all answers to it; an answer to an id that is not open is replied to
    once the clock has passed it, since its proposal could come no more. Rows still open at the end
    wait in ``sink/open`` for the clock to go on. Every folder belongs to one micro-batch, which
    follows from its rows and the batch before, so running it again writes the same again.
    """
    spark, sink = proposals.sparkSession, sink.rstrip("/")
    ttl, slack = F.make_dt_interval(mins=F.lit(minutes)), timedelta(minutes=lateness_minutes)

    def settle(batch: DataFrame, batch_id: int) -> None:
        def write(rows: DataFrame, part: str) -> None:
            rows.write.mode("overwrite").parquet(batch_folder(f"{sink}/{part}", batch_id))

        with scratch(spark):
            rows = freeze(batch, "events")
            latest = _latest(spark, sink, batch_id)
            newest = rows.agg(F.max("at")).first()[0]
            late = F.coalesce(F.col("at") < F.lit(latest and latest - slack), F.col("at").isNull())
            newest = max((t for t in (latest, newest) if t is not None), default=None)
            clock = F.lit(newest and newest - slack).cast("timestamp")
            here = rows.where(~late)
            if batch_id:
                here = here.unionByName(spark.read.schema(EVENTS).parquet(batch_folder(f"{sink}/open", batch_id - 1)))
            here = freeze(here, "here")
            made = _proposals(here)
            over = F.coalesce(F.col("created_at") + ttl < clock, F.lit(False))
            named = made.groupBy("confirmation_id").agg(F.bool_and(over).alias("over"))
            marked = freeze(lookup(here, named, "confirmation_id"), "marked")
            ended = F.coalesce("over", (F.col("kind") == "answer") & F.coalesce(F.col("at") < clock, F.lit(False)))
            done = marked.where(ended)
            write(marked.where(~ended).drop("over"), "open")
            settled = _proposals(done)
            write(match_confirmations(settled, _answers(done), minutes), "proposals")
            passed = rows.where(late)
            unheard = _answers(passed).select(
                "confirmation_id", "seq", "answered_at", F.lit(None).cast("string").alias("status"),
                F.lit(NOT_FOUND).alias("error"),
                *[F.lit(None).cast("string").alias(c) for c in ("action_type", "target_id", "reason")])
            write(confirmation_outcomes(settled, _answers(done), minutes).unionByName(unheard), "replies")
            write(passed, "late")
            write(spark.createDataFrame([(newest,)], "latest timestamp").coalesce(1), "clock")
            for part in ("open", "clock"):  # the batch before is needed to run this one again
                drop(spark, batch_folder(f"{sink}/{part}", batch_id - 2))

    return (
        _events(proposals, answers).writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_replies(spark: SparkSession, sink: str, part: str = "replies") -> DataFrame:
    """One of ``replies``, ``proposals``, ``late`` and ``open`` of all batches so far."""
    if part not in _PARTS:
        raise ValueError(f"unknown part: {part}")
    return spark.read.parquet(f"{sink.rstrip('/')}/{part}").drop("batch")
