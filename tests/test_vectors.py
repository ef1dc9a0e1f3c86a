import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of

from casework.operators import vectors

CHUNKS = "chunk_id long, document_id long, content string, embedding array<float>"


def made(spark, n, dims, seed=0, copies=False):
    rng = random.Random(seed)
    rows = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(n)]
    if copies:
        rows = [rows[i % (n // 3)] for i in range(n)]
    ids = list(range(n))
    rng.shuffle(ids)
    return spark.createDataFrame([(i, i // 2, f"c{i}", r) for i, r in zip(ids, rows)], CHUNKS)


def brute(chunks, queries, k):
    out = []
    for q in queries.collect():
        a = np.array(q.embedding, dtype=np.float32).astype(float)
        scored = []
        for c in chunks.collect():
            if c.embedding is not None and len(c.embedding) == len(q.embedding):
                b = np.array(c.embedding, dtype=np.float32).astype(float)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((math.nan if size == 0 else float(a @ b / size), c.chunk_id))
        scored.sort(key=lambda s: (math.isnan(s[0]), -round(s[0], 9) if s[0] == s[0] else 0, s[1]))
        out += [(q.query_id, i, c) for i, (_, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def asked(chunks, n):
    return chunks.where(f"chunk_id < {n}").selectExpr("chunk_id AS query_id", "embedding")


@pytest.mark.parametrize("per_block", [2048, 5, 1])
@pytest.mark.parametrize("copies", [False, True])
def test_topk_equals_brute_force_in_any_blocks(spark, per_block, copies):
    chunks = made(spark, 240, 16, copies=copies)
    queries = asked(chunks, 12)
    found = vectors.cosine_topk(chunks, queries, 5, 16, per_block * 8 * 16)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect()) == brute(chunks, queries, 5)


def test_zero_vectors_come_last_and_gaps_are_left_out(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "a", [0.0, 0.0]), (2, 1, "b", [1.0, 0.0]), (3, 1, "c", None), (4, 1, "d", [-1.0, 0.0]), (5, 1, "e", [1.0])], CHUNKS)
    queries = spark.createDataFrame([(9, [2.0, 0.0]), (8, [1.0])], "query_id long, embedding array<float>")
    found = vectors.cosine_topk(chunks, queries, 10, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in found] == [(2, 1), (4, 2), (1, 3)]
    assert math.isnan(found[2].score) and found[0].score == 1.0


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_chunk_vector_is_shuffled(spark):
    chunks = made(spark, 240, 16)
    plan = plan_of(vectors.cosine_topk(chunks, asked(chunks, 12), 5, 16, 3 * 8 * 16))
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Query" not in line]
    moved = [line for line in moved if "Broadcast" not in line]  # the blocks, small by their files
    assert moved and all("hashpartitioning(query_id" in line for line in moved)


@pytest.mark.parametrize("held", [1 << 20, 8])
def test_queries_beyond_a_broadcast(spark, settings, monkeypatch, held):
    """No query passes the driver: blocks and slices are met by tasks, over several partitions."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__files__maxPartitionBytes="1024",
             spark__sql__files__openCostInBytes="0")
    monkeypatch.setattr(vectors, "_HELD_ROWS", held)
    monkeypatch.setattr(vectors, "SLICE_BYTES", 50 * 8 * 16)
    chunks = made(spark, 500, 16, copies=True)
    queries = asked(chunks, 60)
    expected = brute(chunks, queries, 4)
    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas", "collect", "first", "toLocalIterator"):
            m.setattr(type(chunks), name, lambda *a, **b: pytest.fail("rows on the driver"))
        found = vectors.cosine_topk(chunks, queries, 4, 16, 7 * 8 * 16)
    plan = plan_of(found)
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect()) == expected


def test_a_batch_holds_no_more_than_its_bytes(spark, settings):
    """Wide rows of blocks and slices reach Python a few at a time, whatever their number."""
    settings(spark__sql__execution__arrow__maxBytesPerBatch="1m")
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 262144) AS wide")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 5


def test_depth_defaults_to_five(spark):
    chunks = made(spark, 30, 4)
    assert vectors.cosine_topk(chunks, asked(chunks, 2), 0, 4).count() == 10


def test_many_slices_in_one_task(spark):
    chunks = made(spark, 5000, 4, copies=True).coalesce(1)
    queries = asked(chunks, 3)
    found = vectors.cosine_topk(chunks, queries, 7, 4)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect()) == brute(chunks, queries, 7)


def test_no_queries_and_no_chunks(spark):
    chunks = made(spark, 10, 4)
    assert vectors.cosine_topk(chunks, asked(chunks, 0), 5, 4).count() == 0
    assert vectors.cosine_topk(chunks.where("chunk_id < 0"), asked(chunks, 3), 5, 4).count() == 0


def test_hash_embedding_is_unit_length_and_case_blind(spark):
    df = spark.createDataFrame([("Late  parcel\nlate",), ("late late PARCEL",), ("",), (None,)], "t string")
    a, b, empty, missing = [r.embedding for r in vectors.hash_embedding(df, "t", 32).collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6
    assert empty == missing == [0.0] * 32


def test_provider_is_called_in_batches_and_checked(spark):
    df = spark.createDataFrame([(str(i) if i % 5 else None,) for i in range(40)], "content string").coalesce(1)

    def lengths(texts):
        assert 0 < len(texts) <= 8
        return [[float(t), 1.0] for t in texts]

    found = vectors.embed_chunks(df, "content", lengths, dims=2)
    assert [r.embedding for r in found.collect()] == [[float(i), 1.0] if i % 5 else None for i in range(40)]

    short = vectors.embed_chunks(df, "content", lambda texts: [[1.0, 1.0]] * (len(texts) - 1), dims=2)
    with pytest.raises(Exception, match="embedding count mismatch: got 7, expected 8"):
        short.collect()


def test_wrong_width_is_reported_not_kept(spark):
    df = spark.createDataFrame([("a",)], "content string")
    row = vectors.embed_chunks(df, "content", lambda texts: [[1.0]] * len(texts), dims=2).first()
    assert (row.embedding, row.embedding_error) == (None, "invalid embedding dimension: got 1, expected 2")


def test_unknown_provider(spark):
    with pytest.raises(ValueError, match="unsupported embedding provider: other"):
        vectors.embed_chunks(spark.createDataFrame([("a",)], "content string"), "content", "other")


def test_backlog_in_id_order(spark):
    chunks = spark.createDataFrame([(i, 1, f"c{i}", None if i % 2 else [1.0]) for i in (9, 3, 4, 7, 1)], CHUNKS)
    assert [r.chunk_id for r in vectors.embedding_backlog(chunks, 2).collect()] == [1, 3]
    done = vectors.embed_backlog(chunks, 2, "hash", 8)
    assert rows_of(done.where("embedding IS NULL"), "chunk_id") == [(7,), (9,)]
    assert vectors.embed_backlog(done, None, "hash", 8).where("embedding IS NULL").isEmpty()
    with pytest.raises(ValueError):
        vectors.embedding_backlog(chunks, 0)

def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Texts that differ may have one vector: here 400 orders' numbers share 8 places."""
    searched, whole = [], vectors.cosine_topk
    monkeypatch.setattr(vectors, "cosine_topk", lambda c, q, *a: searched.append(q.count()) or whole(c, q, *a))
    chunks = vectors.hash_embedding(spark.createDataFrame(
        [(i, i, f"cancel order {i}") for i in range(30)], "chunk_id long, document_id long, content string"), "content", 8)
    queries = spark.createDataFrame([(i, f"cancel ORD-{i}") for i in range(400)], "query_id long, query string")
    found = rows_of(vectors.search_documents(queries, chunks, 3, "hash", 8), "query_id", "rank", "document_id")
    assert searched[0] <= 8
    vector = vectors.hash_embedding(queries, "query", 8)
    assert found == sorted(brute(chunks, vector, 3), key=repr)
    requests = queries.withColumnRenamed("query_id", "request_id")
    assert rows_of(vectors.retrieve_evidence(requests, chunks, 3, "hash", 8), "request_id", "rank", "document_id") == found
    assert searched[1] == searched[0]


def test_pairs_of_rows_do_not_grow_with_small_blocks(spark, monkeypatch):
    seen = []
    whole = vectors._best_of_pairs
    monkeypatch.setattr(vectors, "_best_of_pairs", lambda pairs, *a: seen.append(pairs.count()) or whole(pairs, *a))
    chunks = made(spark, 240, 16).coalesce(1)
    for per_block in (1, 60):
        vectors.cosine_topk(chunks, asked(chunks, 60).coalesce(1), 5, 16, per_block * 8 * 16)
    assert seen[0] == seen[1]


def test_search_finds_the_chunk_that_says_it(spark):
    texts = ["pickup delayed by carrier", "fee schedule for returns", "api key exposure"]
    chunks = spark.createDataFrame([(i, 10 + i, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, content string")
    chunks = vectors.hash_embedding(chunks, "content", 256)
    queries = spark.createDataFrame([(1, "API key exposure"), (2, ""), (3, None)], "query_id long, query string")
    found = vectors.search_documents(queries, chunks, 1, "hash", 256)
    assert rows_of(found, "query_id", "document_id", "content") == [(1, 12, "api key exposure")]
    assert rows_of(vectors.search_errors(queries)) == [(2, "query cannot be empty"), (3, "query cannot be empty")]


def test_evidence_is_searched_once_per_text(spark):
    texts = ["pickup delayed by carrier", "fee schedule for returns", "api key exposure"]
    chunks = spark.createDataFrame([(i, 10 + i, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, content string")
    chunks = vectors.hash_embedding(chunks, "content", 256)
    requests = spark.createDataFrame([(i, texts[i % 3] if i % 7 else "") for i in range(300)], "request_id long, query string")
    found = vectors.retrieve_evidence(requests, chunks, 2, "hash", 256)
    best = found.where("score > 0.99")
    assert rows_of(best, "request_id", "document_id") == sorted(((i, 10 + i % 3) for i in range(300) if i % 7), key=repr)
    assert found.count() == 2 * best.count()
