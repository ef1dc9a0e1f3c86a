"""Token ids on disk: one zstandard frame a document, one dictionary for all.

A corpus folder holds two Parquet tables, written by Spark's own writer so that any store it can
reach will do:

* ``dictionary``: sha256, bytes, width. One row. ``width`` is the size of a stored id.
* ``blocks``: shard, block, dictionary (sha256), at (ids of the shard before the block), doc_ids,
  n_tokens, offsets (one more than documents), payload (the frames, end to end).

Documents lie in ascending doc_id order (nulls last, ties by text) over shards, blocks and frames.
A frame is found by its block's doc_id range and offset and decompressed alone, so reading one
short document costs one block's row and one frame.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.packing import encode_documents, encoded
from casework.llm.tokens import encoder

SAMPLE_DOCUMENTS, SAMPLE_IDS = 400, 16_384  # the dictionary is trained on about so many, cut so long
DICTIONARY_BYTES, LEVEL = 65_536, 3
BLOCK_BYTES = 1 << 20
BLOCKS = ("shard int, block long, dictionary string, at long, doc_ids array<long>, "
          "n_tokens array<long>, offsets array<long>, payload binary")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """From a sample of bounded size: the share of ids whose hash is low enough.

    Only the compression ratio depends on it. Too little to train on gives a plain prefix.
    """
    n = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    limit = int(-(1 << 63) + share * ((1 << 64) - 1))
    few = docs.where(F.xxhash64("doc_id") <= F.lit(min(limit, (1 << 63) - 1))).limit(4 * SAMPLE_DOCUMENTS)
    width = encoder(tokenizer).dtype.itemsize
    part = F.substring("ids", 1, SAMPLE_IDS * width)
    samples = [bytes(r[0]) for r in encode_documents(few, tokenizer, end_id).select(part).collect()]
    samples.sort()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes every row of ``docs`` (doc_id, text, …) to the folder ``path``.

    Null texts are empty documents and hold their end id; null and repeated doc_ids are written
    like any other; an empty table makes a folder without blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = train_dictionary(docs, tokenizer, end_id)
    name, width = hashlib.sha256(data).hexdigest(), encoder(tokenizer).dtype.itemsize
    spark.createDataFrame([(name, data, width)], "sha256 string, bytes binary, width int").coalesce(
        1).write.parquet(f"{path}/dictionary")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    fields = pa.schema([
        ("shard", pa.int32()), ("block", pa.int64()), ("dictionary", pa.string()), ("at", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        ready = _dictionary(data)
        ready.precompute_compress(level=LEVEL)  # once a task, not once a frame
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=ready)
        shard, block, at = TaskContext.get().partitionId(), 0, 0
        ids, sizes, frames, held = [], [], [], 0

        def flush():
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(
                    ([shard], [block], [name], [at], [ids], [sizes], [offsets], [b"".join(frames)]),
                    fields)], schema=fields)

        for doc_ids, counts, line in encoded(batches, tokenizer, end_id):
            ends = np.cumsum(counts)
            for doc_id, size, low, high in zip(doc_ids.to_pylist(), counts.tolist(), (ends - counts).tolist(), ends.tolist()):
                frame = squeeze.compress(line[low:high].tobytes())
                ids.append(doc_id), sizes.append(size), frames.append(frame)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield flush()
                    block, at = block + 1, at + sum(sizes)
                    ids, sizes, frames, held = [], [], [], 0
        if ids:
            yield flush()

    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, str, bytes, np.dtype]:
    kept = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks, kept.sha256, bytes(kept.bytes), np.dtype(f"<u{kept.width}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decompressed from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are unsigned, 32 bits,
    little-endian. A block that names another dictionary is an error.
    """
    blocks, name, data, dtype = _open(spark, path)
    count = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)
    totals = blocks.groupBy("shard").agg(F.sum(count).alias("n")).orderBy("shard").collect()
    before = dict(zip([r.shard for r in totals], np.cumsum([0, *(r.n for r in totals)]).tolist()))
    places = spark.sparkContext.broadcast(before)  # one number a shard
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"block needs dictionary {row['dictionary']}, the folder has {name}")
                offsets, payload, at = row["offsets"], row["payload"], places.value[row["shard"]] + row["at"]
                starts = at + np.cumsum([0, *row["n_tokens"][:-1]])
                for low in range(0, len(row["doc_ids"]), 256):
                    high = min(low + 256, len(row["doc_ids"]))
                    ids = [np.frombuffer(expand.decompress(payload[offsets[i] : offsets[i + 1]]), dtype)
                           for i in range(low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][low:high], pa.int64()), pa.array(starts[low:high], pa.int64()),
                         pa.array([len(i) for i in ids], pa.int64()),
                         pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], schema=fields)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents called ``doc_id``: reads their frames only."""
    blocks, name, data, dtype = _open(spark, path)
    held = blocks.where(F.array_contains("doc_ids", doc_id)).withColumn("i", F.explode(F.filter(
        F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id)))
    low, high = F.get("offsets", F.col("i")), F.get("offsets", F.col("i") + 1)
    frames = held.orderBy("shard", "block", "i").select(
        F.substring("payload", (low + 1).cast("int"), (high - low).cast("int"))).collect()
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
    return [np.frombuffer(expand.decompress(bytes(f[0])), dtype) for f in frames]


def digest(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
