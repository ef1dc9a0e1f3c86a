"""Every operator as a named query over the given tables.

Results are flat and comparable: times as text, decimals as doubles, counts as bigint.
"""

from __future__ import annotations

import functools
import hashlib
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casework.functions import payloads, phrases, scalars, text
from casework.functions.rows import spread
from casework.operators import actions as act
from casework.operators import confirm, context, decide, quality, reports, vectors
from casework.operators.joins import lookup
from casework.plans import fixtures as fx
from casework.schemas import ACCOUNTS, ORDERS, TICKETS
from casework.sources import documents as docs
from casework.sources import sheets, tables, versions
from casework.sources.keyed import Keyed, store_by_key
from casework.sources.numbering import dense_numbers
from casework.streaming import flows, rates, replies
from casework.workspace import freeze, fresh_path

DIMS = 64  # width of the given vectors
LOADED_AT = "2024-02-01 00:00:00"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for digest_provider

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def flat(rows: DataFrame) -> DataFrame:
    """Times to text, decimals and floats to double, integers to bigint."""

    def plain(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        if kind.startswith(("decimal", "float")):
            return c.cast("double")
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("bigint")
        return c.cast("string") if kind == "date" else c

    return rows.select(*[plain(n, k).alias(n) for n, k in rows.dtypes])


def _loaded_at() -> Column:
    return F.lit(LOADED_AT).cast("timestamp")


def _case_tables(spark, sf) -> tuple[DataFrame, ...]:
    return (fx.requests(spark, sf), fx.accounts(spark, sf), fx.shipments(spark, sf),
            fx.tickets(spark, sf), fx.evidence(spark, sf))


# --- loading ----------------------------------------------------------------


def _with_breaks(cells: str) -> Column:
    """Cells with quotes, commas and line breaks: two lines, or three of which one looks like a row."""
    row = F.col("row_no")
    return F.transform(cells, lambda c, i: F.when((i == 1) & (row % 7 == 0), F.concat(c, F.lit(', "x"')))
                       .when((i == 1) & (row % 11 == 0), F.concat(c, F.lit("\n"), c))
                       .when((i == 7) & (row % 13 == 0), F.concat(c, F.lit('\nB2,"Evil",Growth,Active,,,true,x\n'), c))
                       .otherwise(c))


@query
def read_sheet(spark, sf):
    """The account sheet as CSV files and back: quoted cells, line numbers, blank lines, breaks."""
    cells = _with_breaks("cells")
    quoted = F.transform(cells, lambda c: F.when(
        c.rlike('[",\n]') | (F.col("row_no") % 2 == 0),
        F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    line = F.when(F.col("row_no") % 23 == 0, "").otherwise(F.array_join(quoted, ","))
    folder = fresh_path(spark, "sheet")
    fx.raw_accounts(spark, sf).repartitionByRange("row_no").sortWithinPartitions("row_no").select(
        line.alias("value")).write.text(folder)
    rows = sheets.read_sheet_csv(spark, folder)
    return flat(rows.select("row_no", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("line")))


@query
def load_abort(spark, sf):
    """What a load that stops at the first bad row says of each sheet, whole and without the rows
    it would name; the rows that a clean sheet loads."""
    out = []
    for name, parsed in _parsed(spark, sf).items():
        for part, rows in (("whole", parsed), ("clean", parsed.where("reject_reason IS NULL")), ("empty", parsed.where("row_no < 2"))):
            try:
                found = sheets.load(rows, name).agg(F.count("*").alias("rows")).withColumn("error", F.lit(None).cast("string"))
            except sheets.SheetError as error:
                found = spark.range(1).select(F.lit(0).cast("long").alias("rows"), F.lit(str(error)).alias("error"))
            out.append(found.select(F.lit(name).alias("table_name"), F.lit(part).alias("part"), "rows", "error"))
    return functools.reduce(DataFrame.unionByName, out)


@query
def load_accounts(spark, sf):
    return flat(sheets.load(sheets.parse_accounts(fx.raw_accounts(spark, sf)), "accounts", "quarantine"))


@query
def load_orders(spark, sf):
    return flat(sheets.load(sheets.parse_orders(fx.raw_orders(spark, sf)), "orders", "quarantine"))


@query
def load_tickets(spark, sf):
    return flat(sheets.load(sheets.parse_tickets(fx.raw_tickets(spark, sf)), "tickets", "quarantine"))


def _parsed(spark, sf) -> dict[str, DataFrame]:
    return {
        "accounts": sheets.parse_accounts(fx.raw_accounts(spark, sf)),
        "orders": sheets.parse_orders(fx.raw_orders(spark, sf)),
        "tickets": sheets.parse_tickets(fx.raw_tickets(spark, sf)),
    }


@query
def load_rejects(spark, sf):
    a, o, t = (sheets.rejected(p) for p in _parsed(spark, sf).values())
    return flat(a.unionByName(o).unionByName(t))


@query
def load_orphans(spark, sf):
    """Orders and tickets that name no account of the account sheet."""
    parsed = _parsed(spark, sf)
    accounts, out = sheets.accepted(parsed["accounts"]), []
    for name, table in (("order", "orders"), ("ticket", "tickets")):
        good = sheets.accepted(parsed[table]).withColumn("reject_reason", F.lit(None).cast("string"))
        checked = sheets.with_known_accounts(good, accounts, name)
        out.append(sheets.rejected(checked).select(F.lit(table).alias("table_name"), "row_no", "reject_reason"))
    return out[0].unionByName(out[1])


@query
def load_counts(spark, sf):
    return flat(sheets.load_counts(_parsed(spark, sf)))


@query
def document_chunk_counts(spark, sf):
    source = fx.chunk_source(spark, sf)
    return flat(docs.chunk_counts(source, text.chunk_documents(source)))


@query
def snapshot_gate(spark, sf):
    return flat(sheets.snapshot_gate(fx.snapshot_notes(spark, sf), ["workbook"]))


@query
def sheet_preview(spark, sf):
    def named(name, sheet):
        return sheet.select(F.lit(name).alias("sheet"), "row_no", F.array_join("cells", "|").alias("line"))

    rows = named("accounts", fx.raw_accounts(spark, sf))
    rows = rows.unionByName(named("orders", fx.raw_orders(spark, sf)))
    return flat(sheets.sheet_preview(rows.unionByName(named("tickets", fx.raw_tickets(spark, sf)))))


@query
def dedupe_last(spark, sf):
    rows = sheets.accepted(sheets.parse_tickets(fx.raw_tickets(spark, sf)))
    return flat(tables.dedupe_last(rows, ["ticket_id"], "row_no"))


@query
def upsert_accounts(spark, sf):
    target = fx.conform(fx.accounts(spark, sf).where("status = 'Active'"), ACCOUNTS)
    source = sheets.accepted(sheets.parse_accounts(fx.raw_accounts(spark, sf)))
    return flat(tables.upsert(target, source, "account_id", "row_no", _loaded_at()))


@query
def upsert_orders(spark, sf):
    target = fx.conform(fx.shipments(spark, sf).where("status <> 'BOOKED'"), ORDERS)
    source = sheets.accepted(sheets.parse_orders(fx.raw_orders(spark, sf)))
    return flat(tables.upsert(target, source, "order_id", "row_no", _loaded_at()))


@query
def upsert_orders_stored(spark, sf):
    """The same merge into a stored table, in two batches that meet in some keys."""
    target = fx.conform(fx.shipments(spark, sf).where("status <> 'BOOKED'"), ORDERS)
    source = freeze(sheets.accepted(sheets.parse_orders(fx.raw_orders(spark, sf))), "parsed")
    stored = versions.create_table(target, "order_id", fresh_path(spark, "orders"), 4096)
    stored.merge(source.where("row_no % 2 = 0"), "row_no", _loaded_at())
    rest = source.groupBy("order_id").agg(F.max("row_no").alias("last")).where("last % 2 = 1")
    stored.merge(source.join(rest, "order_id", "left_semi"), "row_no", _loaded_at())
    stored.drop_old(keep=1)
    return flat(versions.open_table(spark, stored.path).rows())


@query
def upsert_tickets(spark, sf):
    target = fx.conform(fx.tickets(spark, sf).where("status = 'open'"), TICKETS)
    source = sheets.accepted(sheets.parse_tickets(fx.raw_tickets(spark, sf)))
    return flat(tables.upsert(target, source, "ticket_id", "row_no", _loaded_at(), created="created_record_at"))


@query
def upsert_documents(spark, sf):
    """Known documents of one kind of status, overwritten and extended by the whole registry."""
    target = fx.known_documents(spark, sf).where("status = 'CURRENT'").withColumn("account_id", F.lit("ACCT-OLD"))
    source = docs.document_rows(fx.registry(spark, sf)).withColumn("seq", F.lit(1))
    merged = tables.upsert_documents(target, source, "seq", _loaded_at())
    return flat(merged.drop("effective_from", "effective_to", "metadata"))


@query
def upsert_documents_fields(spark, sf):
    """The same merge where the registry brings dates and the table holds other metadata."""
    target = fx.known_documents(spark, sf).where("status = 'CURRENT'").withColumns({
        "metadata": F.lit('{"source":"old"}'), "effective_to": F.lit("2030-01-01").cast("date")})
    source = docs.document_rows(fx.registry(spark, sf)).withColumns({
        "seq": F.lit(1), "effective_from": F.date_add(F.lit("2024-03-01").cast("date"), F.col("authority_rank")),
        "effective_to": F.when(F.col("status") == "DEPRECATED", F.lit("2024-12-31").cast("date"))})
    merged = tables.upsert_documents(target, source, "seq", _loaded_at())
    return merged.select(
        "filename", F.col("effective_from").cast("string").alias("effective_from"),
        F.col("effective_to").cast("string").alias("effective_to"), "metadata",
        payloads.decode_metadata(F.col("metadata"))["source"].alias("source"))


@query
def assign_ids(spark, sf):
    known = fx.known_documents(spark, sf)
    new = fx.files(spark, sf).join(known.select("filename"), "filename", "left_anti")
    return flat(tables.assign_ids(new.select("filename"), known, ["filename"]))


@query
def replace_chunks(spark, sf):
    """Documents of one language are chunked anew at half the size; empty ones lose theirs."""
    source = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    kept = text.chunk_documents(source).select(
        "*", F.lit("{}").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding")
    )
    redone = source.where("lang = 'en'")
    new = text.chunk_documents(redone, max_bytes=600)
    return flat(tables.replace_chunks(kept, redone, new).select("document_id", "chunk_index", "content"))


@query
def cascade_delete_chunks(spark, sf):
    source = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    left = source.where("lang <> 'en'")
    return flat(tables.cascade_delete_chunks(text.chunk_documents(source), left).select(
        "document_id", "chunk_index", F.octet_length("content").alias("bytes")))


@query
def store_embeddings(spark, sf):
    """The missing vectors arrive, some of them one value short."""
    chunks = fx.chunk_vectors(spark, sf)
    arrived = fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS chunk_id",
        "CASE WHEN vec_id % 34 = 0 THEN slice(embedding, 1, 63) ELSE transform(embedding, x -> -x) END AS embedding",
    )
    stored = tables.store_embeddings(chunks, arrived, DIMS)
    return flat(stored.select("chunk_id", F.size("embedding").alias("width"),
                              F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value")))


@query
def store_embedding_values(spark, sf):
    """Every value of the vectors that arrived whole."""
    arrived = fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS chunk_id",
        "CASE WHEN vec_id % 34 = 0 THEN slice(embedding, 1, 63) ELSE transform(embedding, x -> -x) END AS embedding",
    )
    stored = tables.store_embeddings(fx.chunk_vectors(spark, sf), arrived, DIMS)
    values = stored.select("chunk_id", F.posexplode("embedding").alias("slot", "v"))
    return flat(values.select("chunk_id", "slot", F.round(F.col("v").cast("double"), 6).alias("value")))


@query
def store_embedding_errors(spark, sf):
    arrived = fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS chunk_id",
        "CASE WHEN vec_id % 34 = 0 THEN slice(embedding, 1, 63) ELSE embedding END AS embedding",
    )
    return flat(tables.vector_errors(arrived, "chunk_id", DIMS, "embedding"))


# --- scalar functions -------------------------------------------------------


@query
def nullable_string(spark, sf):
    rows = fx.raw_accounts(spark, sf).select("row_no", F.get("cells", F.lit(4)).alias("cell"))
    return rows.select("row_no", text.nullable_string(F.col("cell")).alias("value"))


@query
def parse_local_time(spark, sf):
    rows = fx.raw_tickets(spark, sf).select("row_no", F.get("cells", F.lit(2)).alias("cell"))
    return flat(rows.where("row_no > 1").select(
        "row_no", "cell", scalars.parse_local_time(F.col("cell")).alias("value"),
        scalars.bad_local_time(F.col("cell")).alias("is_error")))


@query
def parse_bool(spark, sf):
    rows = fx.raw_orders(spark, sf).select("row_no", F.get("cells", F.lit(10)).alias("cell"))
    return rows.select("row_no", "cell", scalars.parse_bool(F.col("cell")).alias("value"))


@query
def parse_fee(spark, sf):
    rows = fx.raw_orders(spark, sf).select("row_no", F.get("cells", F.lit(8)).alias("cell"))
    return flat(rows.select("row_no", "cell", scalars.parse_fee(F.col("cell")).alias("value")))


@query
def normalize_document_text(spark, sf):
    rows = fx.chunk_source(spark, sf)
    return rows.select("document_id", text.normalize_document_text(F.col("text")).alias("text"))


@query
def normalize_match_text(spark, sf):
    rows = fx.chunk_source(spark, sf)
    return rows.select("document_id", text.normalize_match_text(F.col("text")).alias("text"))


@query
def chunk_documents(spark, sf):
    return flat(text.chunk_documents(fx.chunk_source(spark, sf)))


@query
def phrase_flags(spark, sf):
    rows = fx.policy_docs(spark, sf).join(
        fx.accounts(spark, sf).select("account_id", "account_name"), "account_id")
    rows = rows.withColumn("text", text.normalize_match_text(F.col("content")))
    flags = phrases.phrase_flags(F.col("text"), F.col("account_name"))
    return rows.select("document_id", *[c.alias(n) for n, c in flags.items()])


@query
def chunk_metadata_json(spark, sf):
    """Encoded and read back; every fifth cut short on the way."""
    chunks = text.chunk_documents(fx.chunk_source(spark, sf))
    encoded = payloads.chunk_metadata_json(F.col("chunk_index"))
    cut = F.when(F.col("document_id") % 5 == 0, F.left(encoded, F.lit(9))).otherwise(encoded)
    rows = chunks.withColumn("metadata", cut)
    read = payloads.decode_metadata(F.col("metadata"))
    return flat(rows.select(
        "document_id", "chunk_index",
        F.try_element_at(read, F.lit("source")).alias("source"),
        F.try_element_at(read, F.lit("chunk_index")).alias("index_text"),
        payloads.bad_metadata(F.col("metadata")).alias("is_bad")))


@query
def credit_amount(spark, sf):
    amount = scalars.credit_amount(F.col("shipment_fee_inr"))
    return flat(fx.shipments(spark, sf).select(
        "order_id", F.round(amount, 6).alias("amount"), scalars.stored_amount(amount).alias("stored"),
        scalars.money_text(amount).alias("money")))


@query
def pickup_delay(spark, sf):
    rows = context.request_order(fx.requests(spark, sf), fx.shipments(spark, sf)).where("order_found")
    asked, end = F.col("requested_at"), F.col("pickup_window_end")
    return flat(rows.select(
        "request_id", scalars.delay_minutes(asked, end).alias("delay_minutes"),
        scalars.past_pickup(asked, end, 2).alias("past_2h"),
        scalars.past_pickup(asked, end, 4).alias("past_4h")))


@query
def validate_requests(spark, sf):
    return payloads.validate_requests(fx.request_bodies(spark, sf)).drop("body")


@query
def validate_confirmations(spark, sf):
    return payloads.validate_confirmations(fx.confirmation_bodies(spark, sf)).drop("body")


@query
def cancellation_fee(spark, sf):
    requests, accounts, orders, _, evidence = _case_tables(spark, sf)
    summary = decide.cancellation_evidence(requests, accounts, evidence)
    rows = context.request_order(requests, orders).join(summary, "request_id")
    fee = scalars.cancellation_fee(F.col("order_status"), F.col("booked_at"), F.col("requested_at"),
                                   F.col("agreement_count") > 0)
    return flat(rows.where("order_found").select("request_id", "order_status", fee.alias("fee")))


# --- documents and vectors --------------------------------------------------


@query
def scan_documents(spark, sf):
    return flat(docs.scan_documents(fx.files(spark, sf), fx.registry(spark, sf)))


@query
def scan_documents_strict(spark, sf):
    found = docs.scan_documents(fx.files(spark, sf), fx.registry(spark, sf), "fail")
    return found.select("document_id", "filename", "title", "error")


@query
def attach_metadata(spark, sf):
    return flat(docs.attach_metadata(fx.files(spark, sf), fx.registry(spark, sf)))


@query
def assemble_pages(spark, sf):
    return docs.assemble_pages(fx.doc_pages(spark, sf))


_SLOTS: dict[str, int] = {}  # of the words a task has met
_SLOTS_HELD = 1 << 16


def digest_provider(texts: list[str]) -> list[list[float]]:
    """Term counts by the first 32 bits of each term's MD5, L2-normalised."""
    terms = [t.lower().split() for t in texts]
    if len(_SLOTS) > _SLOTS_HELD:
        _SLOTS.clear()
    for w in set().union(*terms) - _SLOTS.keys():
        _SLOTS[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMS
    sizes = [len(t) for t in terms]
    slots = np.fromiter((_SLOTS[w] for t in terms for w in t), np.int64, sum(sizes))
    rows = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(rows * DIMS + slots, minlength=len(texts) * DIMS).reshape(-1, DIMS).astype(np.float64)
    size = np.linalg.norm(counts, axis=1, keepdims=True)
    return (counts / np.where(size == 0, 1.0, size)).tolist()


def _weights(rows: DataFrame, *keys: str) -> DataFrame:
    """Vectors as one row per value above zero."""
    return flat(rows.select(*keys, F.posexplode("embedding").alias("slot", "v")).where("v > 0").select(
        *keys, "slot", F.round(F.col("v").cast("double"), 5).alias("weight")))


@query
def hash_embedding(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "text")
    return _weights(vectors.hash_embedding(rows, "text", DIMS), "doc_id")


@query
def embed_chunks(spark, sf):
    """Chunks through a provider of one's own."""
    chunks = text.chunk_documents(spread(fx.chunk_source(spark, sf)))
    return _weights(vectors.embed_chunks(chunks, "content", digest_provider, DIMS, batch=64),
                    "document_id", "chunk_index")


@query
def embedding_backlog(spark, sf):
    return flat(vectors.embedding_backlog(fx.chunk_vectors(spark, sf)))


@query
def embed_backlog(spark, sf):
    """The whole backlog embedded and stored; vectors that were there stay."""
    done = vectors.embed_backlog(fx.chunk_vectors(spark, sf), None, "hash", DIMS)
    return flat(done.select(
        "chunk_id", F.size("embedding").alias("width"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("square_sum")))


@query
def embed_backlog_values(spark, sf):
    """Every value above zero, of the vectors that were there and of those made now."""
    return _weights(vectors.embed_backlog(fx.chunk_vectors(spark, sf), None, "hash", DIMS), "chunk_id")


@query
def cosine_topk(spark, sf):
    found = vectors.cosine_topk(fx.chunk_vectors(spark, sf), fx.query_vectors(spark, sf), 5, DIMS)
    return flat(found.withColumn("score", F.round("score", 6)))


@query
def cosine_topk_many(spark, sf):
    """Every vector a query, in several blocks."""
    queries = fx.table(spark, sf, "embeddings").selectExpr("vec_id AS query_id", "embedding")
    chunks = freeze(spread(fx.chunk_vectors(spark, sf)), "vectors")
    found = vectors.cosine_topk(chunks, queries, 5, DIMS, block_bytes=8 * DIMS * 200)
    return flat(found.withColumn("score", F.round("score", 6)))


@query
def source_projection(spark, sf):
    chunks = fx.chunk_vectors(spark, sf)
    found = vectors.cosine_topk(chunks, fx.query_vectors(spark, sf), 0, DIMS)
    return flat(vectors.source_projection(found, chunks).withColumn("score", F.round("score", 6)))


def _embedded_chunks(spark, sf) -> DataFrame:
    """All chunks with id and vector, written once: searches read them and embed nothing."""
    chunks = text.chunk_documents(fx.chunk_source(spark, sf))
    numbered = dense_numbers(chunks, ["document_id", "chunk_index"], "chunk_id")
    return freeze(vectors.embed_chunks(numbered, "content", "hash", DIMS), "chunks")


@query
def search_documents(spark, sf):
    """Benchmark items as text queries over the chunks of all documents."""
    embedded = _embedded_chunks(spark, sf)
    queries = fx.table(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    found = vectors.search_documents(queries, embedded, 5, "hash", DIMS)
    return flat(found.select("query_id", "rank", "document_id",
                             F.md5("content").alias("content_md5"), F.round("score", 5).alias("score")))


@query
def authority_rank(spark, sf):
    return flat(reports.authority_rank(fx.known_documents(spark, sf)))


# --- context and decisions --------------------------------------------------


@query
def request_account(spark, sf):
    return context.request_account(fx.requests(spark, sf), fx.accounts(spark, sf)).select(
        "request_id", "account_id", "account_name", "plan", "account_status", "premium_support",
        F.col("account_error").alias("load_error"))


@query
def request_order(spark, sf):
    return flat(context.request_order(fx.requests(spark, sf), fx.shipments(spark, sf)).select(
        "request_id", "order_id", "order_status", "carrier", "shipment_fee", "carrier_fault",
        "customer_fault", "pickup_window_end", "order_account_mismatch",
        F.col("order_error").alias("load_error")))


@query
def request_tickets(spark, sf):
    return flat(context.request_tickets(fx.requests(spark, sf), fx.tickets(spark, sf)))


@query
def security_ticket(spark, sf):
    return context.security_tickets(fx.tickets(spark, sf))


@query
def cancellation_evidence(spark, sf):
    requests, accounts, _, _, evidence = _case_tables(spark, sf)
    return flat(decide.cancellation_evidence(requests, accounts, evidence).drop("has_credit_override"))


@query
def credit_evidence(spark, sf):
    requests, accounts, _, _, evidence = _case_tables(spark, sf)
    return decide.cancellation_evidence(requests, accounts, evidence).select("request_id", "has_credit_override")


def _with_action(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        *[c for c in decisions.columns if c != "action"],
        F.col("action.type").alias("action_type"), F.col("action.target").alias("action_target"),
        F.col("action.reason").alias("action_reason"))


@query
def evaluate_requests(spark, sf):
    return _with_action(decide.evaluate_requests(*_case_tables(spark, sf)))


@query
def evaluate_with_retrieval(spark, sf):
    """Evidence found by searching for each request's own text."""
    requests, accounts, orders, tickets, _ = _case_tables(spark, sf)
    decided = decide.evaluate_requests(requests, accounts, orders, tickets, _searched(spark, sf))
    return _with_action(decided).withColumn("confidence", F.round("confidence", 6))


def _searched(spark, sf) -> DataFrame:
    chunks = freeze(vectors.embed_chunks(fx.policy_chunks(spark, sf), "content", "hash", DIMS), "chunks")
    return vectors.retrieve_evidence(fx.requests(spark, sf), chunks, 5, "hash", DIMS)


@query
def request_sources(spark, sf):
    """What each decision rests on, in order."""
    return flat(_searched(spark, sf).select(
        "request_id", "rank", "document_id", F.md5("content").alias("content_md5"),
        F.round("score", 6).alias("score")))


@query
def service_credit_decision(spark, sf):
    return _with_action(decide.service_credit_decisions(*_case_tables(spark, sf)))


@query
def service_credit_approval(spark, sf):
    """The cap lifted, so that large credits need a manager."""
    return _with_action(decide.service_credit_decisions(*_case_tables(spark, sf), cap=2000.0))


@query
def confirmation_gate(spark, sf):
    gated = decide.gate(decide.evaluate_requests(*_case_tables(spark, sf)))
    return gated.select("request_id", "confirmation_required", "confirmation_id")


@query
def auto_gate(spark, sf):
    gated = decide.gate(decide.evaluate_requests(*_case_tables(spark, sf)), "auto")
    return gated.select("request_id", "execute")


@query
def resolution_rate(spark, sf):
    decisions = decide.evaluate_requests(*_case_tables(spark, sf))
    plans = fx.accounts(spark, sf).select("account_id", "plan")
    rated = reports.resolution_rate(decisions.join(plans, "account_id", "left"), ["plan"])
    return flat(rated.withColumn("rate", F.round("rate", 6)))


@query
def resolution_rate_daily(spark, sf):
    """By the day of the request and the plan of its account."""
    decisions = decide.evaluate_requests(*_case_tables(spark, sf))
    days = fx.requests(spark, sf).select(
        "request_id", F.date_format("requested_at", "yyyy-MM-dd").alias("day"))
    plans = fx.accounts(spark, sf).select("account_id", "plan")
    rows = decisions.join(plans, "account_id", "left").join(days, "request_id")
    return flat(reports.resolution_rate(rows, ["day", "plan"]).withColumn("rate", F.round("rate", 6)))


@query
def stream_resolution_rate(spark, sf):
    """Decisions as a stream of files: a third of the requests are first taken for escalated and of
    another day, and corrected by a later batch."""
    decisions = decide.evaluate_requests(*_case_tables(spark, sf))
    days = fx.requests(spark, sf).select(
        "request_id", F.date_format("requested_at", "yyyy-MM-dd").alias("day"))
    plans = fx.accounts(spark, sf).select("account_id", "plan")
    rows = lookup(decisions, plans, "account_id").join(days, "request_id").select(
        "request_id", "error", "escalate", "needs_agent", "day", "plan")
    rows = freeze(rows.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(3))), "decisions")
    first = rows.withColumns({"seq": F.lit(0), "escalate": F.lit(True), "day": F.lit("2000-01-01")})
    steps = [first.where("part = 0").unionByName(rows.where("part = 1").withColumn("seq", F.lit(0))),
             rows.where("part <> 1").withColumn("seq", F.lit(1))]
    incoming, by = fresh_path(spark, "incoming"), ["day", "plan"]
    counted = rates.create_counted(spark, fresh_path(spark, "counted"), by, rows.count())
    log, stream = fresh_path(spark, "rates"), fresh_path(spark, "stream")
    for step in steps:
        step.write.mode("append").parquet(incoming)
        arriving = spark.readStream.schema(step.schema).parquet(incoming)
        _drain(rates.stream_resolution(arriving, by, "seq", counted, log, stream))
    return flat(rates.read_rates(spark, log, by).withColumn("rate", F.round("rate", 6)))


# --- actions ----------------------------------------------------------------


def _action_tables(spark, sf) -> tuple[DataFrame, ...]:
    return (fx.actions(spark, sf), fx.shipments(spark, sf), fx.tickets(spark, sf),
            fx.escalations0(spark, sf), fx.credits0(spark, sf))


def _outcomes(spark, sf) -> DataFrame:
    return act.apply_action_sequence(*_action_tables(spark, sf))


@query
def apply_action_sequence(spark, sf):
    return flat(_outcomes(spark, sf).withColumn("amount", F.round("amount", 6)))


def _of_type(kind: str) -> Query:
    def run(spark, sf):
        rows = _outcomes(spark, sf).where(F.col("action_type") == kind)
        return flat(rows.select("seq", "target_id", "status_before", "outcome", "error",
                                F.round("amount", 6).alias("amount")))

    return run


for _name, _kind in {
    "apply_cancel": "CANCEL_ORDER", "apply_return": "RETURN_TO_ORIGIN", "apply_escalate": "ESCALATE",
    "apply_credit": "SERVICE_CREDIT", "apply_credit_approval": "SERVICE_CREDIT_APPROVAL",
}.items():
    _run = _of_type(_kind)
    _run.__name__ = _name
    query(_run)


@query
def action_errors(spark, sf):
    return act.action_errors(fx.actions(spark, sf)).select("seq", "action_type", "target_id", "error")


@query
def action_target_state(spark, sf):
    actions, orders, tickets, _, _ = _action_tables(spark, sf)
    return act.action_target_state(actions, orders, tickets).select(
        "seq", "action_type", "target_id", "account_id", "target_status", "error")


@query
def orders_after_actions(spark, sf):
    changed = act.orders_after(fx.shipments(spark, sf), act.order_changes(_outcomes(spark, sf)))
    return flat(changed.select("order_id", "status", "cancellation_requested_at", "updated_at"))


@query
def new_escalations(spark, sf):
    return flat(act.new_escalations(_outcomes(spark, sf)))


@query
def new_credits(spark, sf):
    return flat(act.new_credits(_outcomes(spark, sf)))


@query
def active_escalation(spark, sf):
    found = act.with_active_escalation(fx.tickets(spark, sf), fx.escalations0(spark, sf))
    return found.select("ticket_id", "account_id")


@query
def active_credit(spark, sf):
    found = act.with_active_credit(fx.shipments(spark, sf), fx.credits0(spark, sf))
    return found.select("order_id", "status")


def _audit(spark, sf) -> DataFrame:
    return act.audit_rows(_outcomes(spark, sf))


def _states(audit: DataFrame) -> DataFrame:
    """Audit rows with the JSON states as columns, since JSON text may be spelled many ways."""
    def part(column, key):
        return F.get_json_object(column, f"$.{key}")

    return audit.select(
        "id", "account_id", "action_type", "target_id", "reason",
        part("previous_state", "status").alias("previous_status"),
        part("new_state", "status").alias("new_status"),
        part("new_state", "priority").alias("priority"),
        part("new_state", "requested_by").alias("requested_by"),
        F.round(part("new_state", "amount_inr").cast("double"), 6).alias("amount_inr"), "created_at")


@query
def append_audit(spark, sf):
    """Written as two batches, the second one twice, and read back."""
    path = fresh_path(spark, "audit")
    audit = _audit(spark, sf)
    orders, tickets = (audit.where(F.col("action_type") != "ESCALATE"),
                       audit.where(F.col("action_type") == "ESCALATE"))
    for batch_id, rows in ((0, orders), (1, tickets), (1, tickets)):
        tables.append_audit(rows, path, batch_id)
    return flat(_states(spark.read.schema(audit.schema).parquet(f"{path}/batch=*")))


@query
def append_audit_published(spark, sf):
    """The same batches in a log whose readers see a batch whole, before and after its replay."""
    path = fresh_path(spark, "audit")
    audit = _audit(spark, sf)
    escalated = F.col("action_type") == "ESCALATE"
    for batch_id, part in ((0, ~escalated), (1, escalated), (1, escalated)):
        versions.publish_batch(audit.where(part), path, batch_id)
    return flat(_states(versions.read_batches(spark, path, audit.schema)))


@query
def audit_summary(spark, sf):
    return reports.audit_summary(_audit(spark, sf))


@query
def latest_audit(spark, sf):
    return flat(_states(reports.latest_audit(_audit(spark, sf))))


@query
def latest_escalation(spark, sf):
    return flat(reports.latest_escalation(fx.escalations0(spark, sf)))


# --- confirmations ----------------------------------------------------------


@query
def confirmation_outcomes(spark, sf):
    return flat(confirm.confirmation_outcomes(fx.proposals(spark, sf), fx.answers(spark, sf)))


@query
def match_confirmations(spark, sf):
    return flat(confirm.match_confirmations(fx.proposals(spark, sf), fx.answers(spark, sf)))


# --- streams ----------------------------------------------------------------


def _events(spark, sf) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    return flows.table_stream(spark, f"{sf.rstrip('/')}/events.parquet", schema)


def _drain(stream) -> None:
    stream.awaitTermination()


@query
def stream_confirmations(spark, sf):
    """The events table as a stream of several files, dealt by hash, so that answers arrive out of
    order and before their proposals; then one far-off event to close the watermarks."""
    known = fx.table(spark, sf, "events")
    folder = fresh_path(spark, "events")
    known.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    known.agg(F.max("ts").alias("ts")).selectExpr(
        "-1L AS event_id", "timestampadd(DAY, 400, ts) AS ts", "0L AS user_id",
        "'view' AS event_type", "0D AS value", "'' AS props").write.mode("append").parquet(folder)
    events = flows.table_stream(spark, folder, known.schema, files_per_trigger=2)
    span = known.agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(
        F.min("ts").cast("timestamp"))).alias("us")).first().us
    closing = F.col("confirmation_id") == "CNF--1"
    out = flows.confirmation_stream(
        fx.proposals_of(events), fx.answers_of(events),
        lateness_minutes=(span or 0) // 60_000_000 + 60)  # any event may come last
    sink = fresh_path(spark, "confirmations")
    _drain(out.writeStream.format("parquet").option("path", sink)
           .option("checkpointLocation", fresh_path(spark, "stream"))
           .trigger(availableNow=True).start())
    return flat(spark.read.schema(out.schema).parquet(sink).where(~closing).select(
        "confirmation_id", "seq", "status", "error"))


@query
def stream_replies(spark, sf):
    """The events in six files by time, each dealt by hash, one micro-batch each; then one far-off
    event to close what is open. Answers come up to 13 minutes after the event they belong to."""
    known, folder = fx.table(spark, sf, "events"), fresh_path(spark, "events")
    ends = known.agg(F.min("event_id"), F.max("event_id")).first()  # event ids follow time
    low, n = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1
    _deal(known, F.floor((F.col("event_id") - low) * 6 / n), 6, folder)
    known.agg(F.max("ts").alias("ts")).selectExpr(
        "-1L AS event_id", "timestampadd(DAY, 400, ts) AS ts", "0L AS user_id",
        "'view' AS event_type", "0D AS value", "'' AS props").write.mode("append").parquet(folder)
    events = flows.table_stream(spark, folder, known.schema, files_per_trigger=1)
    sink = fresh_path(spark, "replies")
    _drain(replies.stream_replies(
        fx.proposals_of(events), fx.answers_of(events), sink, fresh_path(spark, "stream"), lateness_minutes=30))
    return flat(replies.read_replies(spark, sink).where("confirmation_id <> 'CNF--1'"))


@query
def stream_evaluate(spark, sf):
    _, accounts, orders, tickets, evidence = _case_tables(spark, sf)
    requests = fx.requests_of(_events(spark, sf), fx.table(spark, sf, "orders"))
    sink = fresh_path(spark, "decisions")
    _drain(flows.stream_evaluate(
        requests, accounts, orders, tickets,
        lambda batch: evidence.join(batch.select("request_id"), "request_id", "left_semi"),
        sink, fresh_path(spark, "stream")))
    return _with_action(spark.read.parquet(sink).drop("batch"))


def _deal(rows: DataFrame, part: Column, files: int, folder: str) -> None:
    """Writes the rows of each part from 0 on as one file, one after the other, since a file stream
    takes files by age. All tasks sort them into parts first, so that a file's task reads its own."""
    path = fresh_path(rows.sparkSession, "parts")
    spread(rows).withColumn("_part", part).write.partitionBy("_part").parquet(path)
    schema = StructType([*rows.schema, StructField("_part", LongType())])
    dealt = rows.sparkSession.read.schema(schema).parquet(path)
    for i in range(files):
        dealt.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)


def _dealt_events(spark, sf, files: int) -> DataFrame:
    """The events as a stream of ``files`` files in order of their ids, one micro-batch each."""
    known, folder = fx.table(spark, sf, "events"), fresh_path(spark, "events")
    most = known.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * files / (most + 1))
    _deal(known, part, files, folder)
    return flows.table_stream(spark, folder, known.schema, files_per_trigger=1)


def _stored(spark, **tables: tuple[DataFrame, str]) -> list[Keyed]:
    return [store_by_key(rows, key, fresh_path(spark, name)) for name, (rows, key) in tables.items()]


@query
def stream_evaluate_searched(spark, sf):
    """Three micro-batches, each with the evidence that a search for its own texts finds."""
    _, accounts, orders, tickets, _ = _case_tables(spark, sf)
    accounts, orders, tickets = _stored(
        spark, accounts=(accounts, "account_id"), orders=(orders, "order_id"), tickets=(tickets, "account_id"))
    requests = fx.requests_of(_dealt_events(spark, sf, 3), fx.table(spark, sf, "orders"))
    chunks = freeze(vectors.embed_chunks(fx.policy_chunks(spark, sf), "content", "hash", DIMS), "chunks")
    sink = fresh_path(spark, "decisions")
    _drain(flows.stream_evaluate(
        requests, accounts, orders, tickets,
        lambda batch: vectors.retrieve_evidence(batch, chunks, 5, "hash", DIMS),
        sink, fresh_path(spark, "stream")))
    decided = spark.read.parquet(sink).drop("batch")
    return _with_action(decided).withColumn("confidence", F.round("confidence", 6))


@query
def stream_apply(spark, sf):
    """The events dealt to 24 files in order of their ids, one micro-batch each."""
    _, orders, tickets, escalations, credits = _action_tables(spark, sf)
    orders, tickets, escalations, credits = _stored(
        spark, orders=(orders, "order_id"), tickets=(tickets, "ticket_id"),
        escalations=(escalations, "ticket_id"), credits=(credits, "order_id"))
    incoming = _dealt_events(spark, sf, 24)
    log = fresh_path(spark, "outcomes")
    _drain(flows.stream_apply(fx.actions_of(incoming), orders, tickets, escalations,
                              credits, log, fresh_path(spark, "stream")))
    return flat(flows.read_outcomes(spark, log).withColumn("amount", F.round("amount", 6)))


@query
def stream_embed(spark, sf):
    schema = fx.table(spark, sf, "documents").schema
    incoming = flows.table_stream(spark, f"{sf.rstrip('/')}/documents.parquet", schema)
    chunks = text.chunk_documents(incoming.withColumnRenamed("doc_id", "document_id")).withColumn(
        "embedding", F.lit(None).cast("array<float>"))
    sink = fresh_path(spark, "vectors")
    _drain(flows.stream_embed(chunks, sink, fresh_path(spark, "stream"), "hash", DIMS))
    return _weights(spark.read.parquet(sink), "document_id", "chunk_index")


# --- integrity --------------------------------------------------------------


def _tables(spark, sf, stored: bool = False) -> quality.Tables:
    """All eight tables, loaded as they come, with repeats, gaps and strays still there.

    ``stored`` writes the parsed rows down first, for checks that read them several times.
    """
    loaded = {n: p.drop("reject_reason") for n, p in _parsed(spark, sf).items()}
    chunks = text.chunk_documents(fx.chunk_source(spark, sf)).withColumns({
        "id": F.concat_ws(":", "document_id", "chunk_index"), "metadata": F.lit("{}")})
    made = {
        "documents": fx.known_documents(spark, sf),
        "document_chunks": chunks,
        "escalations": fx.escalations0(spark, sf),
        "audit_logs": fx.audit_logs(spark, sf),
        "service_credits": fx.credits0(spark, sf),
    }
    return {
        **{n: freeze(p, n) if stored else p for n, p in loaded.items()},
        **{n: fx.faulty(rows, n) for n, rows in made.items()},
    }


@query
def check_unique(spark, sf):
    return quality.check_unique(_tables(spark, sf))


@query
def check_not_null(spark, sf):
    return quality.check_not_null(_tables(spark, sf))


@query
def check_foreign_keys(spark, sf):
    return quality.check_foreign_keys(_tables(spark, sf, stored=True))


@query
def check_enums(spark, sf):
    return quality.check_enums(_tables(spark, sf))


@query
def check_active_unique(spark, sf):
    """After a second load of escalations and credits has repeated them all."""
    escalations, credits = fx.escalations0(spark, sf), fx.credits0(spark, sf)
    return quality.check_active_unique(escalations.unionAll(escalations), credits.unionAll(credits))


@query
def check_amount(spark, sf):
    """Credits with part of the fee taken back."""
    credits = fx.credits0(spark, sf).withColumn(
        "amount_inr", (F.col("amount_inr") - F.lit(40)).cast("decimal(12,2)"))
    return quality.check_amount(credits)


@query
def check_vector_width(spark, sf):
    arrived = fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id", "CASE WHEN vec_id % 34 = 0 THEN slice(embedding, 1, 63) ELSE embedding END AS embedding")
    return quality.check_vector_width(arrived, "vec_id", DIMS)
