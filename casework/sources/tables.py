"""Keyed table maintenance: ids, upserts, chunk replacement, vector and audit writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.payloads import chunk_metadata_json
from casework.operators.joins import lookup
from casework.schemas import VECTOR_WIDTH
from casework.sources.numbering import dense_numbers
from casework.workspace import freeze


def dedupe_last(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row per key by ``seq``; an aggregate, so a hot key is combined map-side."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("_last")
    return rows.groupBy(*key).agg(last).select(*key, "_last.*").select(*rows.columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    seq: str,
    loaded_at: Column,
    created: str = "created_at",
    touched: str | None = "updated_at",
) -> DataFrame:
    """Insert or overwrite by key; nulls in the source do overwrite.

    The deduplicated batch is written down once, as it is read three times: for the matches, for
    the keys already there, and for the rest. Left join + rest instead of a full outer join,
    because a small batch can then be broadcast (Catalyst knows its size) and the table is not
    shuffled.
    ``created`` is the load time of a row's first load and stays; ``touched``, where the table
    has one, is the load time of its last.
    """
    batch = freeze(dedupe_last(source, [key], seq).drop(seq), "batch")
    clocks = [c for c in (created, touched) if c in target.columns]
    carried = [c for c in target.columns if c in batch.columns and c not in (key, *clocks)]
    change = batch.select(key, F.struct(*carried).alias("_new"))

    hit = F.col("_new").isNotNull()
    updated = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in carried}
    if touched in clocks:
        updated[touched] = F.when(hit, loaded_at).otherwise(F.col(touched))
    kept = target.join(change, key, "left").withColumns(updated).select(*target.columns)

    known = target.join(batch.select(key), key, "left_semi").select(key)
    fresh = batch.join(known, key, "left_anti")
    types = {f.name: f.dataType for f in target.schema}
    missing = {c: F.lit(None) for c in target.columns if c not in fresh.columns}
    fresh = fresh.withColumns({**missing, **dict.fromkeys(clocks, loaded_at)}).select(
        *[F.col(c).cast(types[c]).alias(c) for c in target.columns]
    )
    return kept.unionByName(fresh)


def assign_ids(new_rows: DataFrame, existing: DataFrame, order: list[str], id_col: str = "id"):
    """Ids above the existing maximum, dense and in ``order``. One aggregate value is read."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first().top
    return dense_numbers(new_rows.drop(id_col), order, id_col, start=int(top))


def upsert_documents(
    target: DataFrame, source: DataFrame, seq: str, loaded_at: Column
) -> DataFrame:
    """By filename; a known file keeps its id and creation time, a new one gets the next id."""
    merged = upsert(target, source.drop("id"), "filename", seq, loaded_at, touched=None)
    old = merged.where(F.col("id").isNotNull())
    new = assign_ids(merged.where(F.col("id").isNull()), target, ["filename"])
    return old.unionByName(new.select(*old.columns))


def replace_chunks(chunks: DataFrame, documents: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Drop every chunk of ``documents`` (document_id), then add ``new_chunks`` un-embedded.

    A document with no new chunks still loses its old ones.
    """
    kept = lookup(chunks, documents.select("document_id"), "document_id", "left_anti")
    added = new_chunks.select(
        "document_id",
        "chunk_index",
        "content",
        chunk_metadata_json(F.col("chunk_index")).alias("metadata"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return kept.select(*added.columns).unionByName(added)


def store_embeddings(chunks: DataFrame, vectors: DataFrame, dims: int = VECTOR_WIDTH) -> DataFrame:
    """Vectors of the right width written by chunk id; unknown ids change nothing."""
    good = vectors.where(F.size("embedding") == dims).select(
        "chunk_id", F.col("embedding").alias("_vector")
    )
    stored = F.coalesce("_vector", "embedding")
    joined = chunks.join(good, "chunk_id", "left").withColumn("embedding", stored)
    return joined.select(*chunks.columns)


def vector_errors(vectors: DataFrame, id_col: str, dims: int, kind: str) -> DataFrame:
    """Refused vectors with the reason."""
    width = F.coalesce(F.size("embedding"), F.lit(0))
    text = F.concat(
        F.lit(f"invalid {kind} dimension: got "),
        width.cast("string"),
        F.lit(f", expected {dims}"),
    )
    return vectors.where(width != dims).select(id_col, text.alias("error"))


def cascade_delete_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document still exists."""
    return lookup(chunks, documents.select("document_id"), "document_id", "left_semi")


def append_audit(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add audit rows; a batch owns its folder, so writing it again replaces only itself."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
