import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.sources import documents, tables
from casework.sources.numbering import dense_numbers

OLD, NOW = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)


def test_upsert_overwrites_with_nulls_and_keeps_the_rest(spark):
    schema = "k string, a string, b string, created_at timestamp, updated_at timestamp"
    target = spark.createDataFrame([("1", "x", "y", OLD, OLD), ("2", "x", "y", OLD, OLD)], schema)
    source = spark.createDataFrame(
        [(1, "2", "p", "q"), (2, "2", None, "r"), (3, "3", "n", None)], "seq int, k string, a string, b string"
    )
    found = rows_of(tables.upsert(target, source, "k", "seq", F.lit(NOW)))
    assert found == [("1", "x", "y", OLD, OLD), ("2", None, "r", OLD, NOW), ("3", "n", None, NOW, NOW)]


def test_upsert_twice_changes_nothing_but_the_time(spark):
    schema = "k string, a string, created_at timestamp, updated_at timestamp"
    target = spark.createDataFrame([("1", "x", OLD, OLD)], schema)
    source = spark.createDataFrame([(1, "1", "z"), (2, "9", "w")], "seq int, k string, a string")
    once = tables.upsert(target, source, "k", "seq", F.lit(NOW))
    assert rows_of(tables.upsert(once, source, "k", "seq", F.lit(NOW))) == rows_of(once)


def test_documents_keep_their_id(spark):
    cols = "filename string, title string, document_type string, status string, authority_rank int, account_id string, metadata string"
    known = spark.createDataFrame([(7, "a.pdf", "t", "p", "CURRENT", 1, None, "{}", OLD)], f"id long, {cols}, created_at timestamp")
    source = spark.createDataFrame([(f, "T", "p", "CURRENT", 1, None, "{}", 1) for f in ("c.pdf", "a.pdf", "b.pdf")], f"{cols}, seq int")
    merged = tables.upsert_documents(known, source.withColumn("id", F.lit(None)), "seq", F.lit(NOW))
    assert rows_of(merged, "filename", "id", "title", "created_at") == [
        ("a.pdf", 7, "T", OLD), ("b.pdf", 8, "T", NOW), ("c.pdf", 9, "T", NOW)]


@pytest.mark.parametrize("copies", [1, 3])
def test_dense_numbers(spark, copies):
    rows = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("k")).crossJoin(spark.range(copies).toDF("c"))
    numbered = dense_numbers(rows, ["k"], "n", start=10)
    found = numbered.orderBy("n").collect()
    assert [r.n for r in found] == list(range(11, 11 + 2000 * copies))
    assert [r.k for r in found] == sorted(r.k for r in found)


def test_ids_on_an_empty_table_start_at_one(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "k string")
    assert rows_of(tables.assign_ids(rows, spark.createDataFrame([], "id long"), ["k"]), "k", "id") == [("a", 1), ("b", 2)]


def test_replace_chunks(spark):
    old = spark.createDataFrame([(1, 0, "a", "{}", [0.1]), (2, 0, "b", "{}", [0.2]), (3, 0, "c", "{}", [0.3])],
                                "document_id long, chunk_index int, content string, metadata string, embedding array<float>")
    documents_ = spark.createDataFrame([(1,), (2,)], "document_id long")
    new = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "document_id long, chunk_index int, content string")
    found = tables.replace_chunks(old, documents_, new)
    assert rows_of(found, "document_id", "chunk_index", "content", F.col("embedding").isNull()) == [
        (1, 0, "x", True), (1, 1, "y", True), (3, 0, "c", False)]


def test_store_embeddings_refuses_other_widths(spark):
    chunks = spark.createDataFrame([(1, None), (2, None), (3, [9.0, 9.0])], "chunk_id long, embedding array<float>")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (99, [1.0, 2.0])], "chunk_id long, embedding array<float>")
    assert rows_of(tables.store_embeddings(chunks, vectors, 2)) == [(1, [1.0, 2.0]), (2, None), (3, [9.0, 9.0])]
    assert rows_of(tables.vector_errors(vectors, "chunk_id", 2, "embedding")) == [
        (2, "invalid embedding dimension: got 1, expected 2")]


def test_audit_batch_written_twice_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, x string")
    for batch_id in (0, 1, 1):
        tables.append_audit(rows, str(tmp_path / "audit"), batch_id)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_folder_listing_and_registry(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "b.PDF", "c.txt", "d.pdf", "sub/e.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    listed = documents.list_documents(spark, str(tmp_path))
    assert rows_of(listed) == [("a.pdf",), ("d.pdf",)]
    registry = spark.createDataFrame([("a.pdf", "A", "policy", "CURRENT", 1, None)],
                                     "filename string, title string, document_type string, status string, authority_rank int, account_id string")
    assert rows_of(documents.scan_documents(listed, registry), "filename", "title") == [("a.pdf", "A")]
    strict = documents.scan_documents(listed, registry, "fail")
    assert rows_of(strict, "filename", "error") == [("a.pdf", None), ("d.pdf", "unknown document")]


def test_pages_in_order_without_null_pages(spark):
    pages = spark.createDataFrame([("d", 2, "b \r"), ("d", 10, "c"), ("d", 1, " a\n\n"), ("d", 3, None), ("e", 1, None)],
                                  "document string, page int, text string")
    assert rows_of(documents.assemble_pages(pages)) == [("d", "a\nb\nc"), ("e", "")]
