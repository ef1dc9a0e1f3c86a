"""Resolution rates over a stream of decisions, kept up by differences.

Each micro-batch publishes what it adds to and takes from the counts of every group. A decision
that comes again for a request replaces the one before: its group loses the old count and gains the
new one. What was counted last for each request is a stored table of which a batch opens the
buckets of its own requests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from casework.operators.joins import lookup
from casework.operators.reports import outcome_flags
from casework.sources.tables import dedupe_last
from casework.sources.versions import Versioned, create_table, publish_batch, read_batches
from casework.workspace import freeze, scratch

_COUNTS = ("eligible", "resolved", "requests")


def _schema(by: list[str]) -> StructType:
    """A group and its counts; ``requests`` tells a group without eligible ones from none at all."""
    fields = StructType()
    for name in by:
        fields.add(name, "string")
    for name in _COUNTS:
        fields.add(name, "long")
    return fields


def create_counted(spark: SparkSession, path: str, by: list[str], expected_requests: int = 0) -> Versioned:
    """The table of what each request counts for: now, and before the batch that counted it last."""
    counted = _schema(by).simpleString()
    schema = (f"request_id string, batch long, now {counted}, before {counted}, "
              "created_at timestamp, updated_at timestamp")
    none = spark.createDataFrame([], schema)
    return create_table(none, "request_id", path, expected_rows=expected_requests)


def _as_counted(by: list[str]) -> Column:
    eligible, resolved = outcome_flags()
    return F.struct(*[F.col(c).cast("string").alias(c) for c in by],
                    eligible.cast("long").alias("eligible"), resolved.cast("long").alias("resolved"),
                    F.lit(1).cast("long").alias("requests"))


def _differences(change: DataFrame, by: list[str]) -> DataFrame:
    """Counts by group that a batch adds, negative where it takes away."""
    def signed(which: str, sign: int) -> Column:
        c = F.col(which)
        return F.struct(*[c[b].alias(b) for b in by], *[(sign * c[n]).alias(n) for n in _COUNTS])

    rows = change.select(F.inline(F.array(signed("now", 1), signed("before", -1))))
    return rows.where("requests IS NOT NULL").groupBy(*by).agg(*[F.sum(n).alias(n) for n in _COUNTS])


def stream_resolution(
    decisions: DataFrame, by: list[str], seq: str, counted: Versioned, log: str, checkpoint: str
) -> StreamingQuery:
    """Decisions (request_id, error, escalate, needs_agent, the columns ``by``) to counts by group.

    Within a batch the last decision of a request by ``seq`` counts, and later batches correct
    earlier ones. A batch that runs again finds its own number on the rows it had already
    stored and goes by what they counted before, so it publishes the same differences again. Rows
    without a request_id are no request and count nowhere; groups may be null.
    """
    spark = decisions.sparkSession

    def count(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            named = batch.where("request_id IS NOT NULL")
            rows = named.select(F.col("request_id").cast("string"), F.col(seq).alias("seq"), _as_counted(by).alias("now"))
            rows = freeze(dedupe_last(rows, ["request_id"], "seq"), "decisions")
            known = counted.of(rows.select("request_id")).select(
                "request_id", F.when(F.col("batch") == batch_id, F.col("before"))
                .otherwise(F.col("now")).alias("before"))
            change = freeze(lookup(rows, known, "request_id").withColumn(
                "batch", F.lit(batch_id).cast("long")), "change")
            counted.merge(change, "seq", F.current_timestamp())
            publish_batch(_differences(change, by), log, batch_id)
            counted.drop_old()

    return (
        decisions.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_rates(spark: SparkSession, log: str, by: list[str]) -> DataFrame:
    """(by, eligible, resolved, rate) of all published batches; groups that were left have no row."""
    rows = read_batches(spark, log, _schema(by))
    totals = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    rate = F.try_divide(F.col("resolved"), F.col("eligible"))
    return totals.where("requests > 0").drop("requests").withColumn("rate", rate)
