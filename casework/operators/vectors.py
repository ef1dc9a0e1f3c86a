"""Embedding text and finding the nearest chunks by exact cosine."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.functions.rows import computed_once
from casework.functions.text import normalize_match_text
from casework.operators.joins import lookup
from casework.schemas import EMBEDDING_BATCH, RETRIEVAL_DEPTH, VECTOR_WIDTH
from casework.sources.tables import store_embeddings
from casework.workspace import freeze

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Provider = Callable[[list[str]], list[list[float]]]

# Queries and chunks meet in rows of so many bytes each; a block of queries is scored at a time.
QUERY_BLOCK_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
_SCORE_DIGITS = 9  # scores closer than this are ties, settled by chunk id


# --- embedding --------------------------------------------------------------


def hash_embedding(rows: DataFrame, text: str, dims: int = VECTOR_WIDTH) -> DataFrame:
    """Adds ``embedding``: hashed term counts, L2-normalised, ``dims`` wide.

    The provider that needs no network: Spark's own term hashing, row by row in the JVM, so
    nothing is shuffled. Text without terms gives the zero vector.
    """
    terms = F.split(normalize_match_text(F.coalesce(F.col(text), F.lit(""))), " ")
    counter = HashingTF(numFeatures=dims, inputCol="_terms", outputCol="_counts")
    scaler = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit")
    counted = counter.transform(rows.withColumn("_terms", F.array_remove(terms, "")))
    unit = vector_to_array("_unit", dtype="float32")
    return computed_once(scaler.transform(counted), {"embedding": unit}).drop(
        "_terms", "_counts", "_unit"
    )


def embed_column(provider: Provider, batch: int = EMBEDDING_BATCH):
    """A vectorised column function around ``provider``, called with ``batch`` texts at a time.

    A provider that returns another number of vectors than it got texts fails the job. Null text
    gives a null vector.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts[texts.notna()]
            vectors: list = []
            for i in range(0, len(known), batch):
                part = list(known.iloc[i : i + batch])
                got = provider(part)
                if len(got) != len(part):  # fixed value: the error's text
                    raise ValueError(
                        f"embedding count mismatch: got {len(got)}, expected {len(part)}"
                    )
                vectors.extend(got)
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out.loc[known.index] = pd.Series(vectors, index=known.index, dtype=object)
            yield out

    # Spark reads the kind of function off these, and wants types rather than their names.
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # Called non-deterministic so that no filter makes Spark call the provider twice per row.
    return F.pandas_udf(embed, "array<float>").asNondeterministic()


def embed_chunks(
    rows: DataFrame,
    text: str = "content",
    provider: str | Provider = "hash",
    dims: int = VECTOR_WIDTH,
    batch: int = EMBEDDING_BATCH,
) -> DataFrame:
    """Adds ``embedding`` and ``embedding_error`` (a vector of the wrong width is dropped)."""
    if callable(provider):
        made = rows.withColumn("embedding", embed_column(provider, batch)(F.col(text)))
    elif provider == "hash":
        made = hash_embedding(rows, text, dims)
    else:
        raise ValueError(f"unsupported embedding provider: {provider}")
    width = F.size("embedding")
    error = F.concat(  # fixed value: the error's text
        F.lit("invalid embedding dimension: got "), width.cast("string"),
        F.lit(f", expected {dims}"),
    )
    wrong = F.col("embedding").isNotNull() & (width != dims)
    return made.withColumn("embedding_error", F.when(wrong, error)).withColumn(
        "embedding", F.when(~wrong, F.col("embedding"))
    )


def embedding_backlog(chunks: DataFrame, limit: int = EMBEDDING_BATCH) -> DataFrame:
    """The first ``limit`` chunks without a vector, by id."""
    if limit <= 0:
        raise ValueError(f"invalid batch size: {limit}")
    waiting = chunks.where(F.col("embedding").isNull())
    return waiting.drop("embedding").orderBy("chunk_id").limit(limit)


def embed_backlog(
    chunks: DataFrame,
    limit: int | None = EMBEDDING_BATCH,
    provider: str | Provider = "hash",
    dims: int = VECTOR_WIDTH,
) -> DataFrame:
    """Chunks with the next ``limit`` of the backlog embedded; ``None`` drains it in one go."""
    if limit is None:
        todo = chunks.where(F.col("embedding").isNull()).drop("embedding")
    else:
        todo = embedding_backlog(chunks, limit)
    vectors = embed_chunks(todo, "content", provider, dims).where(
        F.col("embedding_error").isNull()
    )
    return store_embeddings(chunks, vectors.select("chunk_id", "embedding"), dims)


# --- retrieval --------------------------------------------------------------

_CANDIDATES = "query_id bigint, chunk_id bigint, score double"
_BLOCK_ROWS, _SLICE_ROWS = 1024, 512  # queries and chunks scored at once
_HELD_ROWS = 1 << 22  # found rows a task holds before it hands them on


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """List column to an (n, dims) array of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row becomes NaN, as its cosine is undefined."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _ranks(scores: np.ndarray) -> np.ndarray:
    """Scores as integers of ``_SCORE_DIGITS`` decimals, NaN below everything."""
    lowest = -(10**_SCORE_DIGITS) - 1
    scaled = np.rint(np.nan_to_num(scores, nan=0.0) * 10.0**_SCORE_DIGITS).astype(np.int64)
    return np.where(np.isnan(scores), lowest, scaled)


def _slice_best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k best of one slice, whose ``ids`` ascend.

    Rank and position share one integer, so a partition without a sort still settles ties.
    """
    picked = np.broadcast_to(ids, scores.shape)
    if len(ids) <= k:
        return picked, scores
    keys = _ranks(scores) * _SLICE_ROWS - np.arange(len(ids))
    best = np.argpartition(keys, len(ids) - k, axis=1)[:, -k:]
    return np.take_along_axis(picked, best, axis=1), np.take_along_axis(scores, best, axis=1)


def _merge_best(
    top: tuple[np.ndarray, np.ndarray], queries: np.ndarray, ids: np.ndarray, chunks: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """``top`` (ids and scores per query, best first) after more chunks were seen; ``ids`` ascend.

    Once a query has k rows, only a better score than its last one's, or an equal score and a
    smaller id, can change them. Scores in single precision, off by less than ``far``, tell which
    queries such a chunk may exist for; only those are scored in double precision.
    """
    top_ids, top_scores = top
    small = queries.astype(np.float32), chunks.astype(np.float32)
    far = (queries.shape[1] + 8) * 2.0**-23
    for start in range(0, len(ids), _SLICE_ROWS):
        part = slice(start, start + _SLICE_ROWS)
        if top_ids.shape[1] < k:  # rows are missing everywhere
            new = _slice_best(ids[part], queries @ chunks[part].T, k)
            top_ids, top_scores = _best_of((top_ids, top_scores), new, k)
            continue
        last = top_scores[:, -1]
        equal = np.where(ids[start] < top_ids[:, -1], -0.5, 0.5)
        least = (_ranks(last) + equal) / 10.0**_SCORE_DIGITS - 1e-12
        rough = small[0] @ small[1][part].T
        near = (rough >= (least - far).astype(np.float32)[:, None]).any(axis=1)
        todo = np.flatnonzero(near | np.isnan(last))
        scores = queries[todo] @ chunks[part].T
        better = scores >= least[todo, None]
        n = better.sum(axis=1)
        many = (n > k) | np.isnan(last[todo])
        row, at = np.nonzero(better & ~many[:, None])
        place = np.arange(len(row)) - (np.cumsum(np.where(many, 0, n)) - np.where(many, 0, n))[row]
        few = np.full((len(todo), k), -1, dtype=np.int64), np.full((len(todo), k), -2.0)  # below any score
        few[0][row, place], few[1][row, place] = ids[part][at], scores[row, at]
        for rows, new in ((~many & (n > 0), few), (many, None)):
            if rows.any():
                new = _slice_best(ids[part], scores[rows], k) if new is None else tuple(x[rows] for x in new)
                of = todo[rows]
                top_ids[of], top_scores[of] = _best_of((top_ids[of], top_scores[of]), new, k)
    return top_ids, top_scores


def _best_of(
    top: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two (ids, scores) per query, best first."""
    ids, scores = (np.concatenate(pair, axis=1) for pair in zip(top, new))
    best = np.lexsort((ids, -_ranks(scores)), axis=1)[:, :k]
    return np.take_along_axis(ids, best, axis=1), np.take_along_axis(scores, best, axis=1)


def _packed(rows: DataFrame, key: str, dims: int, size: int) -> DataFrame:
    """Runs of up to ``size`` vectors of a partition, each one row of bytes: ``{key}s``, values.

    Only vectors of ``dims`` values are taken. Values are doubles, scaled to unit length, and in a
    run ids ascend.
    """
    rows = rows.where(F.size("embedding") == dims).select(F.col(key).cast("bigint"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = np.empty(0, dtype=np.int64), np.empty((0, dims))

        def row(n: int) -> pa.RecordBatch:
            order = np.argsort(ids[:n], kind="stable")
            run_of = [pa.array([a[:n][order].tobytes()], pa.binary()) for a in (ids, matrix)]
            return pa.RecordBatch.from_arrays(run_of, [f"{key}s", f"{key}_values"])

        for batch in batches:
            ids = np.concatenate([ids, batch.column(key).to_numpy()])
            matrix = np.concatenate([matrix, _unit(_matrix(batch.column("embedding"), dims))])
            while len(ids) >= size:
                yield row(size)
                ids, matrix = ids[size:], matrix[size:]
        if len(ids):
            yield row(len(ids))

    return rows.mapInArrow(run, f"{key}s binary, {key}_values binary")


def _best_of_pairs(pairs: DataFrame, k: int, dims: int, size: int) -> DataFrame:
    """(query_id, chunk_id, score): per task and query the k best of the (block, slice) pairs.

    A task holds one pair, of which ``size`` queries are scored at a time, and the best rows of the
    blocks it has met, which it hands on when they reach ``_HELD_ROWS``.
    """
    size = min(size, _BLOCK_ROWS)

    def table(ids: np.ndarray, tops: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        return pa.table(
            {
                "query_id": pa.array(np.repeat(ids, tops[0][0].shape[1]), pa.int64()),
                "chunk_id": pa.array(np.concatenate([t[0].ravel() for t in tops]), pa.int64()),
                "score": pa.array(np.concatenate([t[1].ravel() for t in tops]), pa.float64()),
            }
        )

    def doubles(value: pa.Scalar) -> np.ndarray:
        return np.frombuffer(value.as_buffer()).reshape(-1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        held = 0
        for batch in batches:
            for block, ids, values, chunk_ids, chunk_values in zip(*batch.columns):
                block = block.as_py()
                if block not in met:
                    asked = np.frombuffer(ids.as_buffer(), dtype=np.int64).copy()
                    if held + len(asked) * k > _HELD_ROWS:
                        for done in met.values():
                            yield from table(*done).to_batches()
                        met, held = {}, 0
                    held += len(asked) * k
                    met[block] = asked, [
                        (np.empty((len(asked[i : i + size]), 0), dtype=np.int64),
                         np.empty((len(asked[i : i + size]), 0))) for i in range(0, len(asked), size)]
                tops, queries = met[block][1], doubles(values)
                chunk, matrix = np.frombuffer(chunk_ids.as_buffer(), dtype=np.int64), doubles(chunk_values)
                for i, top in enumerate(tops):
                    tops[i] = _merge_best(top, queries[i * size : (i + 1) * size], chunk, matrix, k)
        for done in met.values():
            yield from table(*done).to_batches()

    return pairs.mapInArrow(run, _CANDIDATES)


def cosine_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = RETRIEVAL_DEPTH,
    dims: int = VECTOR_WIDTH,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` nearest chunks per query: (query_id, rank, chunk_id, score), exact.

    Score is 1 - cosine distance. Chunks without a vector are left out, a zero vector scores NaN
    and comes last, ties go to the lower chunk id; ``k <= 0`` means the default depth. Queries of
    another width find nothing here: ``vector_errors`` names them.

    Queries are written once as rows of at most ``QUERY_BLOCK_BYTES`` to the shared folder, a file
    each, chunks are cut into slices where they lie, and tasks stream slices past queries as matrix
    products, for at most ``block_bytes`` of queries at a time. Neither side is shuffled by a key
    and none passes the driver, unless Spark finds one small enough to broadcast. Only k rows per
    query and task are shuffled. A task keeps one partition of queries, of which
    ``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes`` allow 32 rows by default; slices
    are never gathered. Chunks are read once per partition of queries: write computed vectors down
    first.
    """
    k = k if k > 0 else RETRIEVAL_DEPTH
    asked = _packed(queries.hint("rebalance"), "query_id", dims, max(1, QUERY_BLOCK_BYTES // (8 * dims)))
    blocks = freeze(
        asked.select(F.monotonically_increasing_id().alias("block"), *asked.columns), "blocks",
        maxRecordsPerFile=1)
    slices = _packed(chunks, "chunk_id", dims, max(1, SLICE_BYTES // (8 * dims)))
    pairs = slices.crossJoin(blocks).select(*blocks.columns, *slices.columns)
    found = _best_of_pairs(pairs, k, dims, max(1, block_bytes // (8 * dims)))
    order = Window.partitionBy("query_id").orderBy(
        F.isnan("score"), F.desc(F.round("score", _SCORE_DIGITS)), "chunk_id"
    )
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def source_projection(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked hits as (query_id, rank, document_id, content, score)."""
    return found.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id").select(
        "query_id", "rank", "document_id", "content", "score"
    )


def _search_texts(
    texts: DataFrame, key: str, chunks: DataFrame, k: int, provider: str | Provider, dims: int
) -> tuple[DataFrame, DataFrame]:
    """(key, vector) of the rows ``texts`` (key, query), and the hits of each vector.

    Equal vectors find equal chunks, so each distinct one is searched once, however many texts
    have it.
    """
    made = embed_chunks(texts, "query", provider, dims).where(F.size("embedding") == dims)
    made = freeze(made.select(key, "embedding"), "asked")
    number = F.monotonically_increasing_id().alias("vector")
    vectors = freeze(made.select("embedding").distinct().select(number, "embedding"), "vectors")
    found = cosine_topk(chunks, vectors.withColumnRenamed("vector", "query_id"), k, dims)
    hits = source_projection(found, chunks).withColumnRenamed("query_id", "vector")
    return lookup(made, vectors, "embedding", "inner").select(key, "vector"), hits


def search_documents(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = RETRIEVAL_DEPTH,
    provider: str | Provider = "hash",
    dims: int = VECTOR_WIDTH,
) -> DataFrame:
    """Text queries (query_id, query) to their sources. Empty queries are refused beforehand:
    see ``search_errors``."""
    asked = queries.where(F.col("query") != "").select("query_id", "query")
    named, hits = _search_texts(asked, "query_id", chunks, k, provider, dims)
    return lookup(named, hits, "vector", "inner").select(
        "query_id", "rank", "document_id", "content", "score")


def retrieve_evidence(
    requests: DataFrame,
    chunks: DataFrame,
    k: int = RETRIEVAL_DEPTH,
    provider: str | Provider = "hash",
    dims: int = VECTOR_WIDTH,
) -> DataFrame:
    """Evidence for requests (request_id, query): the k nearest chunks to each query, by ``rank``.

    Each distinct text is embedded once and each distinct vector searched once; the hits are joined
    back to all requests at the end.
    """
    asked = requests.where(F.col("query") != "").select("request_id", "query")
    named, hits = _search_texts(asked.select("query").distinct(), "query", chunks, k, provider, dims)
    return lookup(lookup(asked, named, "query", "inner"), hits, "vector", "inner").select(
        "request_id", "rank", "document_id", "content", "score")


def search_errors(queries: DataFrame) -> DataFrame:
    blank = F.coalesce("query", F.lit("")) == ""
    return queries.where(blank).select("query_id", F.lit("query cannot be empty").alias("error"))
