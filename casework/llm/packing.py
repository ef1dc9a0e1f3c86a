"""Packing by concatenate and cut: one long line of ids, cut into windows of equal length.

Two passes. The first encodes every document, writes the ids with the document's place in its
partition, and leaves one total per partition. A prefix sum over those totals gives every
document its place in the whole line; the second pass cuts at each multiple of the window. A
document that crosses a cut leaves one piece on each side, also between partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.tables import ship
from casework.llm.tokens import encoder
from casework.workspace import freeze

WINDOW = 1024


def encoded(batches, tokenizer: str, end_id: int):
    """Per block of rows: their doc_ids, number of ids, and all ids end to end, each text's with ``end_id``."""
    tool = encoder(tokenizer)
    for batch in batches:
        for block in arrays.blocks(batch.column("text")):
            ids, sizes = tool.encode_block(block)
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype(tool.dtype, copy=False)
            yield batch.column("doc_id").slice(block.first, len(block)), sizes + 1, ids


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, at, doc_id, tokens, ids): each text's ids and ``end_id``, little-endian."""
    ship(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()),
                        ("tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for doc_ids, sizes, ids in encoded(batches, tokenizer, end_id):
            edges = np.concatenate([[0], np.cumsum(sizes)])
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [
                None, pa.py_buffer((edges * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            places = at + edges[:-1]
            at += int(edges[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(places), doc_ids, pa.array(sizes), raw],
                schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "part int, at long, doc_id long, tokens long, ids binary")


def places_of(parts: DataFrame) -> dict[int, int]:
    """Ids before each partition, from (part, tokens): one number a partition on the driver."""
    totals = parts.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    before, places = 0, {}
    for r in totals:
        places[r.part] = before
        before += r.n
    return places


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset) of every row of ``docs``.

    ``start`` counts the document's ids before the piece, ``offset`` those before it in its
    sequence; ``ids`` are little-endian, unsigned, 32 bits. Every sequence but the last is full.
    Null texts are empty and still have their end id; null and repeated doc_ids are rows like any
    other; an empty table has no pieces. Documents lie in the order of their files.
    """
    rows = freeze(encode_documents(docs, tokenizer, end_id), "ids")
    places = rows.sparkSession.sparkContext.broadcast(places_of(rows))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        dtype, known = encoder(tokenizer).dtype, places.value
        for batch in batches:
            out = [[] for _ in schema]
            size = 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "tokens")),
                           batch.column("ids")):
                part, at, doc_id, tokens, ids = row
                whole = np.frombuffer(ids.as_buffer(), dtype).astype("<u4")
                first = known[part] + at
                cuts = range((first // window + 1) * window, first + tokens, window)
                edges = [0, *(c - first for c in cuts), tokens]
                for low, high in zip(edges, edges[1:]):
                    place = first + low
                    for column, value in zip(out, (doc_id, low, whole[low:high].tobytes(), tokens,
                                                   place // window, place % window)):
                        column.append(value)
                size += 4 * tokens
                if size > 4 * arrays.BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out, size = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return rows.mapInArrow(
        run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): pieces put together, padded to the window.

    A sequence whose length is a power of two stays as it is. A group is one window at most.
    """
    ids = F.collect_list(F.struct("offset", "ids"))
    joined = F.aggregate(F.sort_array(ids), F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    n = (F.octet_length("ids") / 4).cast("int")
    short = F.bit_count("n_tokens") != 1
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.greatest(F.lit(0), window - F.col("n_tokens")))
    return (
        pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_tokens", n)
        .select("sequence_id", "n_tokens",
                F.when(short, F.concat("ids", F.unhex(pad))).otherwise(F.col("ids")).alias("ids")))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the length and crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
