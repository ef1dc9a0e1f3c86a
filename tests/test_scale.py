"""What must hold when one key has a third of the rows, and what plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from casework.operators import actions, confirm, context, decide
from casework.operators.joins import lookup
from casework.plans import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def skewed(settings):
    """Thresholds low enough for test-sized tables."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1",
             spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="60KB",
             spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
             spark__sql__adaptive__advisoryPartitionSizeInBytes="40KB",
             spark__sql__adaptive__coalescePartitions__enabled="false")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def numbers(spark, n=60_000):
    return spark.range(0, n, 1, 8).withColumn("hot", F.col("id") % 3 == 0)


def accounts(spark):
    return spark.range(2000).selectExpr("concat('A', id) AS account_id", "concat('Name', id) AS account_name", "'Growth' AS plan",
                                        "'Active' AS status", "true AS premium_support")


def test_hot_account_is_split(spark, skewed):
    requests = numbers(spark).selectExpr("id AS request_id", "md5(cast(id AS string)) AS query",
                                         "if(hot, 'A0', concat('A', id % 2000)) AS account_id", "'' AS order_id")
    tickets = spark.range(4000).selectExpr("concat('T', id) AS ticket_id", "concat('A', id % 1500) AS account_id",
                                           "timestamp'2026-01-01' AS created_at", "'Possible API key exposure' AS subject", "'open' AS status")
    found = context.request_account(requests, accounts(spark), tickets)
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    assert found.where("security_ticket_id IS NOT NULL").count() == requests.where(
        "cast(substring(account_id, 2) AS int) < 1500").count()


def test_hot_account_of_one_instant_is_ranked_whole(spark, skewed):
    tickets = numbers(spark, 30_000).selectExpr("concat('T', lpad(id, 6, '0')) AS ticket_id", "if(hot, 'A0', concat('A', id % 500)) AS account_id",
                                                "timestamp'2026-01-01' AS created_at", "'open' AS status", "'s' AS subject")
    ranked = context.account_tickets(tickets)
    assert "Window [row_number" not in final_plan(ranked)
    per = ranked.groupBy("account_id").agg(F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"),
                                           F.countDistinct("position").alias("d"), F.min_by("ticket_id", "position").alias("first"),
                                           F.max("ticket_id").alias("newest"))
    assert per.where("lo <> 1 OR hi <> n OR d <> n OR first <> newest").isEmpty()
    assert ranked.count() == 30_000


def test_hot_request_evidence_is_split(spark, skewed):
    evidence = numbers(spark).selectExpr("if(hot, 7L, id % 3000) AS request_id", "id AS document_id",
                                         "concat('name7 cannot cancel ', md5(cast(id AS string))) AS content", "id / 60000D AS score")
    names = spark.range(3000).selectExpr("id AS request_id", "concat('Name', id) AS account_name")
    found = decide.evidence_summary(names, evidence)
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    row = found.where("request_id = 7").first()
    expected = evidence.where("request_id = 7")
    assert (row.deny_count, row.best_score) == (expected.count(), expected.agg(F.max("score")).first()[0])


def test_hot_target_is_split(spark, skewed):
    made = numbers(spark).selectExpr("id AS seq", "'CANCEL_ORDER' AS action_type", "if(hot, 'O0', concat('O', id % 3000)) AS target_id",
                                     "md5(cast(id AS string)) AS reason", "timestamp'2026-01-01' AS acted_at", "cast(NULL AS double) AS amount_inr")
    orders = spark.range(3000).selectExpr("concat('O', id) AS order_id", "'A1' AS account_id", "'BOOKED' AS status",
                                          "cast(10 AS decimal(12,2)) AS shipment_fee_inr")
    tickets = spark.createDataFrame([], "ticket_id string, account_id string, status string")
    none = spark.createDataFrame([], "ticket_id string, order_id string, status string")
    out = actions.apply_action_sequence(made, orders, tickets, none, none)
    plan = final_plan(out)
    assert "SortMergeJoin(skew=true)" in plan and "Window" not in plan
    assert out.where("outcome = 'executed'").count() == made.select("target_id").distinct().count()


def test_hot_confirmation_id_is_split(spark, skewed):
    answers = numbers(spark).selectExpr("if(hot, 'C0', concat('C', id % 3000)) AS confirmation_id", "id AS seq",
                                        "timestamp'2026-01-01 00:01:00' AS answered_at", "id % 2 = 0 AS confirm")
    proposals = spark.range(3000).selectExpr("concat('C', id) AS confirmation_id", "timestamp'2026-01-01' AS created_at",
                                             "'CANCEL_ORDER' AS action_type", "concat('O', id) AS target_id", "md5(cast(id AS string)) AS reason")
    out = confirm.confirmation_outcomes(proposals, answers)
    assert final_plan(out).count("SortMergeJoin(skew=true)") >= 1
    assert out.where("status IS NOT NULL").count() == answers.select("confirmation_id").distinct().count()


def test_lookup_ignores_null_keys(spark):
    fact = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, n int")
    dim = spark.createDataFrame([(None, "x"), ("a", "y")], "k string, v string")
    assert sorted(tuple(r) for r in lookup(fact, dim, "k").select("n", "v").collect()) == [(1, None), (2, "y"), (3, None)]
    assert [r.n for r in lookup(fact, dim, "k", "left_semi").collect()] == [2]


def test_scans_read_only_what_is_asked(spark):
    plan = fx.requests(spark, SF_DIR).select("request_id")._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"event_id:bigint", "o_orderkey:bigint"}
    plan = fx.tickets(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan


def test_decisions_use_no_python_and_no_cross_join(spark):
    df = decide.evaluate_requests(fx.requests(spark, SF_DIR), fx.accounts(spark, SF_DIR), fx.shipments(spark, SF_DIR),
                                  fx.tickets(spark, SF_DIR), fx.evidence(spark, SF_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "CartesianProduct", "NestedLoop", "Window"):
        assert unwanted not in plan


def test_numbering_moves_the_rows_once(spark, settings):
    from casework.sources.numbering import dense_numbers
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    numbered = dense_numbers(spark.range(1000, numPartitions=7).withColumnRenamed("id", "v"), ["v"], "n")
    assert sorted(tuple(r) for r in numbered.collect()) == [(i, i + 1) for i in range(1000)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_one_row_group_is_spread_before_embedding(spark, tmp_path):
    """A file that one task reads is not chunked and embedded by that task alone."""
    from casework.functions.rows import spread
    from casework.plans.library import QUERIES

    rows = spark.range(200).selectExpr("id AS doc_id", "concat('line ', id, '\n\nmore') AS text").coalesce(1)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    held = spread(spark.read.parquet(str(tmp_path / "documents.parquet"))).groupBy(F.spark_partition_id()).count()
    assert held.count() >= 4
    found = QUERIES["embed_chunks"](spark, str(tmp_path))
    assert found.select("document_id").distinct().count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RoundRobinPartitioning")


def test_sheets_of_one_row_group_are_parsed_by_many_tasks(spark):
    rows = fx.raw_orders(spark, "/root/testdata/sf0.001")
    assert rows.groupBy(F.spark_partition_id()).count().count() >= 4


def test_a_stream_is_dealt_in_one_pass(spark, tmp_path, monkeypatch):
    """One file per part, the oldest first; the table is not read again for every part."""
    from casework.plans import library

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def part(i):
        seen.add(1)
        return i // 250

    rows = spark.range(1000).withColumn("doubled", F.col("id") * 2)
    library._deal(rows, part("id"), 5, str(tmp_path / "dealt"))
    assert seen.value == 1000
    files = sorted((tmp_path / "dealt").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    found = [sorted(r.id for r in spark.read.schema(rows.schema).parquet(str(f)).collect()) for f in files]
    assert found == [list(range(i * 250, i * 250 + 250)) for i in range(4)] + [[]]
    assert rows.columns == ["id", "doubled"] == [f.name for f in rows.schema]
