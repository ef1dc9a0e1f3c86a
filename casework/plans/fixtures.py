"""Casework tables derived from the star-schema inputs, as plain column rules.

Every function takes (spark, sf_dir) and reads whole tables. Times are UTC instants.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casework.functions.rows import spread


STAMP = "2026-08-16 11:00"


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` in the shape of ``schema``, absent columns null."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def accounts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('ACCT-', c_custkey) AS account_id",
        "c_name AS account_name",
        """CASE c_mktsegment WHEN 'BUILDING' THEN 'Enterprise'
             WHEN 'AUTOMOBILE' THEN 'Growth' ELSE 'Standard' END AS plan""",
        "CASE WHEN c_acctbal < 0 THEN 'Suspended' ELSE 'Active' END AS status",
        "c_acctbal > 8000 AS premium_support",
        "timestamp'2024-01-01 00:00:00' AS created_at",
        "timestamp'2024-01-01 00:00:00' AS updated_at",
    )


def shipments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('ORD-', o_orderkey) AS order_id",
        "concat('ACCT-', o_custkey) AS account_id",
        "o_orderpriority AS carrier",
        """CASE o_orderstatus
             WHEN 'O' THEN CASE WHEN o_orderkey % 6 = 5 THEN 'DRAFT' ELSE 'BOOKED' END
             WHEN 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'RETURN_TO_ORIGIN' ELSE 'PICKED_UP' END
             ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'CANCELLED' ELSE 'DELIVERED' END
           END AS status""",
        "cast(o_totalprice / 50 AS decimal(12,2)) AS shipment_fee_inr",
        "o_orderkey % 3 <> 0 AS carrier_fault",
        "o_orderkey % 7 = 0 AS customer_fault",
        "cast(o_orderdate AS timestamp) AS booked_at",
        """CASE WHEN o_orderkey % 11 = 0 THEN NULL
             ELSE timestampadd(HOUR, o_orderkey % 5, cast(o_orderdate AS timestamp))
           END AS pickup_window_end""",
        "cast(NULL AS timestamp) AS cancellation_requested_at",
        "timestamp'2024-01-01 00:00:00' AS created_at",
        "timestamp'2024-01-01 00:00:00' AS updated_at",
    )


def tickets_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").selectExpr(
        "concat('TCK-', event_id) AS ticket_id",
        "concat('ACCT-', user_id) AS account_id",
        "cast(ts AS timestamp) AS created_at",
        "CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status",
        """CASE WHEN event_id % 20 = 0 THEN 'Possible API key exposure'
             WHEN event_id % 10 = 0 THEN 'POSSIBLE api KEY exposure'
             ELSE 'Pickup delayed' END AS subject""",
        "event_type AS description",
    )


def tickets(spark, sf_dir) -> DataFrame:
    return tickets_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame, orders: DataFrame) -> DataFrame:
    joined = events.join(orders, events.event_id == orders.o_orderkey)
    return joined.selectExpr(
        "event_id AS request_id",
        """CASE WHEN event_id % 101 = 0 THEN ''
             ELSE concat('Please cancel ORD-', event_id) END AS query""",
        """CASE WHEN event_id % 97 = 0 THEN 'ACCT-NONE'
             WHEN event_id % 50 = 0 THEN concat('ACCT-', user_id)
             ELSE concat('ACCT-', o_custkey) END AS account_id""",
        """CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'ORD-NONE'
             ELSE concat('ORD-', event_id) END AS order_id""",
        """timestampadd(HOUR, (event_id * 13) % 12, cast(o_orderdate AS timestamp))
             AS requested_at""",
        "event_type AS channel",
    )


def requests(spark, sf_dir) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"))


def policy_docs(spark, sf_dir) -> DataFrame:
    """Account-bound documents, one row per (account, document)."""
    customers = table(spark, sf_dir, "customer")
    texts = F.expr(
        r"""filter(array(
          named_struct('slot', 1L, 'content', CASE WHEN c_custkey % 3 = 0 THEN concat(c_name,
            '  may cancel any BOOKED shipment before pickup\nwith no cancellation fee.') END),
          named_struct('slot', 2L, 'content', CASE WHEN c_custkey % 15 = 0 THEN concat(c_name,
            ' cannot cancel shipments on public holidays.') END),
          named_struct('slot', 3L, 'content', CASE WHEN c_custkey % 4 = 0 THEN concat(c_name,
            ' receives a fixed INR 300 service credit if a pickup is more than 4 hours past the',
            ' end of the window and the carrier is at fault.') END)
        ), d -> d.content IS NOT NULL)"""
    )
    return customers.select("c_custkey", F.explode(texts).alias("d")).selectExpr(
        "concat('ACCT-', c_custkey) AS account_id",
        "c_custkey * 10 + d.slot AS document_id",
        "d.content AS content",
    )


DEFAULT_POLICY = "An order that is BOOKED, not yet PICKED_UP may be cancelled."


def policy_chunks(spark, sf_dir) -> DataFrame:
    """Every account's documents and the default policy, each one chunk."""
    own = policy_docs(spark, sf_dir).select("document_id", "content")
    default = spark.range(1).select(
        F.lit(0).cast("bigint").alias("document_id"), F.lit(DEFAULT_POLICY).alias("content")
    )
    return own.unionByName(default).withColumn("chunk_id", F.col("document_id"))


def evidence(spark, sf_dir) -> DataFrame:
    asked = requests(spark, sf_dir).select("request_id", "account_id", "channel")
    own = asked.join(policy_docs(spark, sf_dir), "account_id").selectExpr(
        "request_id", "document_id", "content",
        "((request_id * 37 + document_id) % 60 + 40) / 100D AS score",
    )
    default = asked.where("channel <> 'click'").select(
        "request_id", F.lit(0).cast("bigint").alias("document_id"),
        F.lit(DEFAULT_POLICY).alias("content"), F.lit(0.5).alias("score"),
    )
    return own.unionByName(default)


def actions_of(events: DataFrame) -> DataFrame:
    return events.where("event_type IN ('purchase', 'signup')").selectExpr(
        "event_id AS seq",
        """CASE event_id % 7 WHEN 0 THEN 'CANCEL_ORDER' WHEN 1 THEN 'CANCEL_ORDER'
             WHEN 2 THEN 'RETURN_TO_ORIGIN' WHEN 3 THEN 'SERVICE_CREDIT'
             WHEN 4 THEN 'SERVICE_CREDIT_APPROVAL' WHEN 5 THEN 'ESCALATE'
             ELSE 'REFUND' END AS action_type""",
        """CASE WHEN event_id % 71 = 0 THEN ''
             WHEN event_id % 7 = 5 THEN concat('TCK-', event_id - event_id % 3)
             ELSE concat('ORD-', event_id div 4) END AS target_id""",
        "concat('r', event_id) AS reason",
        "cast(ts AS timestamp) AS acted_at",
        "cast(NULL AS double) AS amount_inr",
    )


def actions(spark, sf_dir) -> DataFrame:
    return actions_of(table(spark, sf_dir, "events"))


def credits0(spark, sf_dir) -> DataFrame:
    return shipments(spark, sf_dir).where("carrier = '1-URGENT'").withColumn(
        "k", F.expr("try_cast(substring(order_id, 5) AS bigint)")
    ).selectExpr(
        "k AS id", "order_id", "account_id",
        "cast(10 + k % 90 AS decimal(12,2)) AS amount_inr", "'earlier' AS reason",
        """CASE k % 4 WHEN 0 THEN 'PENDING_APPROVAL' WHEN 1 THEN 'APPROVED'
             WHEN 2 THEN 'ISSUED' ELSE 'REJECTED' END AS status""",
        "'agent' AS requested_by", "booked_at AS created_at",
    )


def escalations0(spark, sf_dir) -> DataFrame:
    return tickets(spark, sf_dir).where("status = 'closed'").withColumn(
        "k", F.expr("try_cast(substring(ticket_id, 5) AS bigint)")
    ).selectExpr(
        "k AS id", "ticket_id", "account_id", "'earlier' AS reason",
        "CASE WHEN k % 2 = 0 THEN 'P1' ELSE 'P2' END AS priority",
        "CASE WHEN k % 2 = 0 THEN 'created' ELSE 'cancelled' END AS status",
        "'agent' AS requested_by", "created_at",
    )


def proposals_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'view'").selectExpr(
        "concat('CNF-', event_id) AS confirmation_id",
        "cast(ts AS timestamp) AS created_at",
        "CASE WHEN event_id % 2 = 0 THEN 'CANCEL_ORDER' ELSE 'RETURN_TO_ORIGIN' END AS action_type",
        "concat('ORD-', event_id div 4) AS target_id",
        "concat('r', event_id) AS reason",
    )


def proposals(spark, sf_dir) -> DataFrame:
    return proposals_of(table(spark, sf_dir, "events"))


def answers_of(events: DataFrame) -> DataFrame:
    """First answers, second answers a minute later, answers a minute before their proposal, and
    answers to ids nobody proposed."""
    rows = F.expr(
        """CASE
          WHEN event_type = 'view' AND event_id % 10 = 7 THEN
            transform(sequence(0, 1), n -> named_struct(
              'confirmation_id', concat('CNF-', event_id),
              'seq', event_id * 2 + n,
              'answered_at', timestampadd(MINUTE, if(n = 1, -1, event_id % 12), cast(ts AS timestamp)),
              'confirm', n = 1 OR event_id % 4 <> 0))
          WHEN event_type = 'view' AND event_id % 9 <> 0 THEN
            transform(sequence(0, if(event_id % 6 = 0, 1, 0)), n -> named_struct(
              'confirmation_id', concat('CNF-', event_id),
              'seq', event_id * 2 + n,
              'answered_at', timestampadd(MINUTE, event_id % 12 + n, cast(ts AS timestamp)),
              'confirm', event_id % 4 <> 0))
          WHEN event_type = 'signup' AND event_id % 25 = 0 THEN
            array(named_struct(
              'confirmation_id', concat('CNF-X', event_id),
              'seq', event_id * 2,
              'answered_at', cast(ts AS timestamp),
              'confirm', true))
        END"""
    )
    return events.select(F.explode(rows).alias("a")).select("a.*")


def answers(spark, sf_dir) -> DataFrame:
    return answers_of(table(spark, sf_dir, "events"))


# --- raw sheets -------------------------------------------------------------
# The cells pass through explode, so that each row's list is built once and not once per cell.
# The rows are dealt to all cores, as parsing them costs far more and row groups may be few.


def raw_accounts(spark, sf_dir) -> DataFrame:
    """The account sheet: row 1 is the header; faults planted by key."""
    header = spark.range(1).selectExpr("1L AS row_no", "array('account_id') AS cells")
    body = spread(table(spark, sf_dir, "customer")).selectExpr(
        "c_custkey + 2 AS row_no",
        """explode(array(slice(array(
             concat('ACCT-', CASE WHEN c_custkey % 19 = 5 THEN c_custkey - 1 ELSE c_custkey END),
             c_name,
             CASE WHEN c_custkey % 41 = 7 THEN 'Gold' WHEN c_mktsegment = 'BUILDING'
               THEN 'Enterprise' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Growth'
               ELSE 'Standard' END,
             CASE WHEN c_acctbal < 0 THEN 'Suspended' ELSE 'Active' END,
             CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE concat(' csm', c_custkey % 7, ' ') END,
             CASE WHEN c_custkey % 3 = 0 THEN concat('f', c_custkey, '.pdf') ELSE '' END,
             CASE WHEN c_custkey % 29 = 3 THEN 'yes' WHEN c_acctbal > 8000 THEN 'TRUE'
               ELSE 'f' END,
             concat('note ', c_custkey)),
           1, CASE WHEN c_custkey % 37 = 11 THEN 6 ELSE 8 END))) AS cells""",
    )
    return header.unionByName(body)


def raw_orders(spark, sf_dir) -> DataFrame:
    header = spark.range(1).selectExpr("1L AS row_no", "array('order_id') AS cells")
    body = spread(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey + 2 AS row_no",
        """explode(array(slice(array(
             concat('ORD-', CASE WHEN o_orderkey % 23 = 9 THEN o_orderkey - 1 ELSE o_orderkey END),
             concat('ACCT-', o_custkey),
             o_orderpriority,
             CASE o_orderstatus WHEN 'O' THEN 'BOOKED' WHEN 'P' THEN 'PICKED_UP'
               ELSE CASE WHEN o_orderkey % 43 = 1 THEN 'LOST' ELSE 'DELIVERED' END END,
             CASE WHEN o_orderkey % 47 = 2 THEN '2026-02-30 10:00'
               ELSE concat(' ', date_format(o_orderdate, 'yyyy-MM-dd'), ' 09:30 ') END,
             CASE WHEN o_orderkey % 4 = 0 THEN ''
               ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 9:05') END,
             CASE WHEN o_orderkey % 53 = 3 THEN 'soon'
               ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 18:00') END,
             '   ',
             CASE WHEN o_orderkey % 59 = 4 THEN 'INR 20' WHEN o_orderkey % 61 = 5 THEN '1e11'
               ELSE cast(cast(o_totalprice AS decimal(12,2)) AS string) END,
             CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '1' END,
             CASE WHEN o_orderkey % 67 = 6 THEN 'no' WHEN o_orderkey % 7 = 0 THEN 'T'
               ELSE 'False' END,
             CASE WHEN o_orderkey % 71 = 7 THEN '10:00' ELSE '' END,
             CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('  n', o_orderkey) END),
           1, CASE WHEN o_orderkey % 73 = 8 THEN 12 ELSE 13 END))) AS cells""",
    )
    return header.unionByName(body)


def raw_tickets(spark, sf_dir) -> DataFrame:
    header = spark.range(1).selectExpr("1L AS row_no", "array('ticket_id') AS cells")
    body = spread(table(spark, sf_dir, "events")).where("event_type = 'error'").selectExpr(
        "event_id + 2 AS row_no",
        """explode(array(slice(array(
             concat('TCK-', CASE WHEN event_id % 17 = 4 THEN event_id % 300 ELSE event_id END),
             concat('ACCT-', user_id),
             CASE WHEN event_id % 31 = 1 THEN '' WHEN event_id % 37 = 2 THEN 'yesterday'
               ELSE date_format(ts, 'yyyy-MM-dd HH:mm') END,
             CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END,
             'Pickup delayed', event_type,
             CASE WHEN event_id % 2 = 0 THEN ' email ' ELSE '' END,
             '',
             CASE WHEN event_id % 41 = 3 THEN '2024/01/01 10:00'
               WHEN event_id % 5 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm') ELSE '' END,
             concat('fixed ', event_id)),
           1, CASE WHEN event_id % 43 = 5 THEN 8 WHEN event_id % 4 = 0 THEN 9 ELSE 10 END)))
           AS cells""",
    )
    return header.unionByName(body)


def snapshot_notes(spark, sf_dir) -> DataFrame:
    """One notes sheet per conversation; stamped right, wrong, both or not at all."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS workbook",
        "turn + 1 AS row_no",
        f"""CASE
             WHEN turn = 0 AND conv_id % 4 IN (0, 1) THEN
               array('Dataset snapshot', '{STAMP}', 'Asia/Kolkata')
             WHEN turn = 1 AND conv_id % 4 IN (1, 2) THEN
               array('Dataset snapshot:', '2026-08-15 11:00', role)
             ELSE array(role, cast(turn AS string)) END AS cells""",
    )


# --- documents and vectors --------------------------------------------------


def registry(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source <> 'src1'").selectExpr(
        "concat('d', doc_id, '.pdf') AS filename",
        "concat(source, ' ', doc_id) AS title",
        """CASE doc_id % 3 WHEN 0 THEN 'support_policy' WHEN 1 THEN 'cancellation_sop'
             ELSE 'customer_agreement' END AS document_type""",
        """CASE doc_id % 4 WHEN 0 THEN 'DEPRECATED' WHEN 1 THEN 'ACTIVE'
             ELSE 'CURRENT' END AS status""",
        "cast(doc_id % 4 + 1 AS int) AS authority_rank",
        """CASE WHEN doc_id % 3 = 2 THEN concat('ACCT-', doc_id % 50) END AS account_id""",
    )


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS document_id",
        """concat('d', doc_id, CASE WHEN doc_id % 13 = 1 THEN '.PDF'
             WHEN doc_id % 13 = 2 THEN '.txt' ELSE '.pdf' END) AS filename""",
    )


def chunk_source(spark, sf_dir) -> DataFrame:
    """Documents as they are, with CRLF and lone CR line ends planted."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS document_id",
        r"""CASE doc_id % 4 WHEN 1 THEN replace(text, '\n', ' \r\n\t')
              WHEN 2 THEN replace(text, '\n', '\r') ELSE text END AS text""",
    )


def doc_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS document", "turn AS page",
        "CASE WHEN turn % 7 = 6 THEN NULL ELSE text END AS text",
    )


def chunk_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS chunk_id", "cast(label AS bigint) AS document_id",
        "concat('chunk ', vec_id) AS content",
        "CASE WHEN vec_id % 17 = 0 THEN NULL ELSE embedding END AS embedding",
    )


def query_vectors(spark, sf_dir) -> DataFrame:
    """One query per label: the mean of all its vectors."""
    rows = table(spark, sf_dir, "embeddings").withColumn("v", array_to_vector("embedding"))
    means = rows.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(
        F.col("label").cast("bigint").alias("query_id"), vector_to_array("m").alias("embedding")
    )


def known_documents(spark, sf_dir) -> DataFrame:
    """Registered documents as the documents table."""
    return registry(spark, sf_dir).selectExpr(
        "cast(substring(filename, 2, length(filename) - 5) AS bigint) AS id", "*",
        "CASE WHEN authority_rank = 2 THEN date'2024-01-01' END AS effective_from",
        "cast(NULL AS date) AS effective_to",
        """'{"source":"assessment_pdf"}' AS metadata""",
        "timestamp'2024-01-01 00:00:00' AS created_at",
    )


def audit_logs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(
        "event_id AS id", "concat('ACCT-', user_id) AS account_id", "'CANCEL_ORDER' AS action_type",
        "concat('ORD-', event_id) AS target_id", "concat('r', event_id) AS reason",
    )


# What the integrity checks must find, by table: a number of the row, the columns that are null
# where number % 97 = 5, 6, …, and the columns with a stray value where number % 83 = 7, 8, …
# A row comes twice where number % 89 = 3. Both engines read these expressions.
FAULTS: dict[str, tuple[str, tuple[str, ...], dict[str, str]]] = {
    "documents": (
        "id", ("filename", "title", "document_type", "status", "authority_rank", "metadata"),
        {"account_id": "'ACCT-GONE'"}),
    "document_chunks": (
        "document_id * 7 + chunk_index", ("document_id", "chunk_index", "content", "metadata"),
        {"document_id": "-document_id - 1"}),
    "escalations": (
        "id", ("ticket_id", "account_id", "reason", "priority", "status"),
        {"ticket_id": "'TCK-GONE'", "account_id": "'ACCT-GONE'", "priority": "'P9'", "status": "'lost'"}),
    "audit_logs": (
        "id", ("account_id", "action_type", "target_id", "reason"), {"account_id": "'ACCT-GONE'"}),
    "service_credits": (
        "id", ("order_id", "account_id", "amount_inr", "reason", "status", "requested_by"),
        {"order_id": "'ORD-GONE'", "account_id": "'ACCT-GONE'", "status": "'LOST'"}),
}


def fault_cases(name: str) -> dict[str, str]:
    """Column to expression, for the columns of a table that have planted faults."""
    number, nulls, strays = FAULTS[name]
    out = {}
    for column in dict.fromkeys((*nulls, *strays)):
        rules = ""
        if column in nulls:
            rules += f" WHEN ({number}) % 97 = {5 + nulls.index(column)} THEN NULL"
        if column in strays:
            rules += f" WHEN ({number}) % 83 = {7 + list(strays).index(column)} THEN {strays[column]}"
        out[column] = f"CASE{rules} ELSE {column} END"
    return out


def faulty(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the planted faults of their table."""
    cases = fault_cases(name)
    twice = f"explode(sequence(0, if(({FAULTS[name][0]}) % 89 = 3, 1, 0))) AS _copy"
    shown = [f"{cases[c]} AS {c}" if c in cases else c for c in rows.columns]
    return rows.selectExpr(*shown, twice).drop("_copy")


def request_bodies(spark, sf_dir) -> DataFrame:
    """Requests as JSON lines, with faults planted by key."""
    return requests(spark, sf_dir).selectExpr(
        "request_id",
        r"""CASE request_id % 11
             WHEN 0 THEN concat('{"query": "', query, '", "account_id":')
             WHEN 1 THEN concat('{"query": "', query, '"} {"account_id": "', account_id, '"}')
             WHEN 2 THEN concat('{"query": ', request_id, ', "account_id": "a", "order_id": "o"}')
             WHEN 3 THEN concat('{"query": "', query, '", "order_id": "', order_id, '"}')
             WHEN 4 THEN concat('{"query": "', query, '", "extra": [1, {"x": null}], "order_id": "',
               order_id, '", "account_id": " ', account_id, ' "}')
             WHEN 5 THEN concat('{"query": null, "account_id": "', account_id, '"}')
             WHEN 6 THEN concat('{"query": "  \\t ", "account_id": "', account_id, '"}')
             WHEN 7 THEN concat('["', query, '"]')
             ELSE concat(' {"query": " ', query, ' ", "account_id": "', account_id,
               '", "order_id": "', order_id, '"} ') END AS body""",
    )


def confirmation_bodies(spark, sf_dir) -> DataFrame:
    """Answers as JSON lines, with faults planted by key."""
    return answers(spark, sf_dir).selectExpr(
        "seq",
        r"""CASE seq % 7
             WHEN 0 THEN concat('{"confirmation_id": "', confirmation_id, '"')
             WHEN 1 THEN concat('{"confirmation_id": "', confirmation_id, '"}')
             WHEN 2 THEN concat('{"confirmation_id": "', confirmation_id, '", "confirm": "yes"}')
             WHEN 3 THEN '{"confirm": true}'
             ELSE concat('{"confirmation_id": " ', confirmation_id, ' ", "confirm": ',
               cast(confirm AS string), '}') END AS body""",
    )
