"""Suffix-array dedup: bytes covered by a long string that occurs elsewhere are removed.

A place is repeated if the ``length`` bytes from it on (its window) start at another place too, in
any text. In the suffix order of all places equal windows are neighbours; among those the previous
and the next smaller place give an earlier occurrence, if there is one (longest previous factor of
at least ``length``), and any neighbour at all gives some other occurrence.

One suffix array of a corpus fits no task, so places are dealt out so that equal windows meet:

1. Every window has an anchor, the least hash among its stretches of GRAM bytes. Neighbouring
   windows share it, so a text becomes a list of slices: places with one anchor, and the bytes that
   their windows cover. Equal windows have equal anchors at equal distances.
2. Slices are counted by (anchor, hash of their bytes). A slice whose bytes come again is repeated
   as a whole, and one whose anchor does not come again is not; that decides nearly all, on rows of
   a few numbers. What is left are the borders of repeated passages.
3. The bytes of each distinct slice left under an anchor are sent to that anchor's group. There,
   suffixes are sorted, and earlier and other occurrences read off their neighbours.
4. An anchor with more than GROUP distinct slices (a passage that a large part of the corpus quotes)
   is split first: its slices are cut into stretches of STEP places, which have the bytes that all
   their windows share as their anchor, and go through 2 and 3 again; what is still too many after
   that goes by single windows, whose bytes alone decide.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.tables import ship, text_key
from casework.operators.joins import lookup
from casework.workspace import freeze, release

LENGTH = 200  # bytes
GRAM = 64
GROUP = 512  # distinct slices of an anchor that one group takes
STEP = 8  # places
BUCKET_BYTES = 4 << 20  # of slices that a task sorts together
ROWS = 20_000  # in an Arrow batch
_OTHER = (0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def _least_at(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of the least (the first of equal ones)."""
    at, now, span = np.arange(len(hashes)), hashes, 1
    steps = []
    while 2 * span <= width:
        steps.append(span)
        span *= 2
    for step in [*steps, width - span]:
        if step:
            swap = now[step:] < now[:-step]
            at = np.where(swap, at[step:], at[:-step])
            now = np.where(swap, now[step:], now[:-step])
    return at


def slices(block: arrays.Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text in the block, first place, number of places, anchor's place, its hash, bytes' hash."""
    data, prefix, second = block.data, arrays.Prefix(block.data), arrays.Prefix(block.data, *_OTHER)
    grams = np.arange(max(0, len(data) - gram + 1))
    anchors = _least_at(prefix.of(grams, grams + gram), length - gram + 1) if len(data) >= length else grams[:0]
    of = np.searchsorted(block.at, np.arange(len(anchors)), side="right") - 1
    begins = np.arange(len(anchors)) + length <= block.at[of + 1]  # windows end inside their text
    begins[1:] &= (np.diff(anchors) > 0) | (np.diff(of) > 0)
    first = np.flatnonzero(begins)
    row, at = of[first], anchors[first]
    last = np.minimum(np.append(first[1:], len(data)) - 1, block.at[row + 1] - length)
    # Equal bytes with the anchor elsewhere are another slice.
    content = second.of(first, last + length) ^ arrays.mix((at - first).astype(np.uint64) + np.uint64(1))
    return row, first - block.at[row], last - first + 1, at - block.at[row], prefix.of(at, at + gram), content


def _place() -> Column:
    """Which place comes first: smallest doc_id, nulls last, then text, then byte."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "first", "count", "anchor_at")


def _slice_rows(length: int, gram: int):
    names = ["doc_id", "text_key", "first", "count", "anchor_at", "anchor", "content"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                row, first, count, at, anchor, content = slices(block, length, gram)
                take = pa.array(row + block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("text_key").take(take),
                     *(pa.array(x.astype(np.int32)) for x in (first, count, at)),
                     pa.array(arrays.signed(anchor)), pa.array(arrays.signed(content))], schema=schema)

    return run


_SLICE = "doc_id long, text_key long, first int, count int, anchor_at int, anchor long, content long"
_CUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("count", pa.int32()),
                  ("anchor_at", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("bytes", pa.binary())])


def _cut(length: int):
    """A text's wanted slices with their bytes."""
    schema = _CUT.append(pa.field("hot", pa.bool_()))

    def run(batches):
        seen = set()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "text_key", "text", "wanted"))):
                doc_id, key = doc_id.as_py(), key.as_py()
                if (doc_id, key) in seen:  # a repeated row is the same document
                    continue
                seen.add((doc_id, key))
                raw = text.as_py().encode()
                for w in wanted.as_py():
                    first, count = w["first"], w["count"]
                    out.append((doc_id, key, first, count, w["anchor_at"], w["anchor"], w["content"],
                                raw[first : first + count + length - 1], w["hot"]))
                if len(out) >= ROWS:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    return run


def _long(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _split(length: int, step: int):
    """Slices as stretches of places whose distances to the anchor have one quotient by ``step``."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                doc_id, key, first, count, at, anchor, _, raw = row
                low, high = at - first - count + 1, at - first
                for j in range(low // step, high // step + 1):
                    near, far = max(low, step * j), min(high, step * (j + 1) - 1)
                    begin, last = at - far - first, at - near - first
                    piece = raw[begin : last + length]
                    shared = raw[at - step * j - first : at - step * (j + 1) + 1 - first + length]
                    head = b"%d %d " % (anchor, j)
                    out.append((doc_id, key, first + begin, far - near + 1, at, _long(head + shared),
                                _long(b"%d %d " % (near, far) + piece), piece))
                if len(out) >= ROWS:
                    yield _batch(out, _CUT)
                    out = []
            if out:
                yield _batch(out, _CUT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def window_order(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place on, in the order of the bytes; equal, equal."""
    width = 1
    while 2 * width <= min(length, 8):
        width *= 2
    n = len(data) - width + 1
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = (key << np.uint64(8)) | data[j : j + n]
    rank = np.unique(key, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        high = rank[step:]
        rank = np.unique(rank[: len(high)] * np.int64(len(data) + 1) + high, return_inverse=True)[1]
        width += step
    return rank


def _windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slices' bytes end to end, and of every window its slice and where it starts."""
    pieces = table.column("bytes").to_pylist()
    size = np.array([len(p) for p in pieces], np.int64)
    count = size - length + 1
    of = np.repeat(np.arange(len(pieces)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(pieces), np.uint8), of, (np.cumsum(size) - size)[of] + within


def _matched(length: int, keep_first: bool):
    """Of one bucket's slices, the ranges of places whose window starts elsewhere (or earlier)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unnamed", "ascending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("first", "ascending")])
        places = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text_key", "first"))))
        table = table.take([i for i, p in enumerate(places) if not i or p != places[i - 1]])  # repeated rows
        data, of, start = _windows(table, length)
        hashes = arrays.Prefix(data).of(start, start + length)
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        alive = np.unique(of[times[which] > 1])  # the others have no window that comes again
        table = table.take(pa.array(alive))
        data, of, start = _windows(table, length)
        if not len(of):
            return schema.empty_table()
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        within = np.arange(len(of)) - begin[of]
        rank = window_order(data, length)[start]
        order = np.argsort(rank, kind="stable")  # equal windows by place, the first one first
        same = rank[order][1:] == rank[order][:-1]
        hit = np.zeros(len(of) + 1, bool)
        hit[order[1:][same]] = True  # the place before in suffix order is an earlier occurrence
        if not keep_first:
            hit[order[:-1][same]] = True
        edge = hit[:-1].copy()
        edge[1:] &= ~(hit[:-2] & (of[1:] == of[:-1]))
        starts = np.flatnonzero(edge)
        stop = hit[:-1].copy()
        stop[:-1] &= ~(hit[1:-1] & (of[1:] == of[:-1]))
        ends = np.flatnonzero(stop)
        take = pa.array(of[starts])
        first = table.column("first").combine_chunks().to_numpy()[of[starts]]
        return pa.table(
            [table.column("doc_id").take(take), table.column("text_key").take(take),
             pa.array((first + within[starts]).astype(np.int32)), pa.array((first + within[ends]).astype(np.int32))],
            schema=schema)

    return run


def _whole(found: DataFrame, contents: DataFrame, keep_first: bool) -> DataFrame:
    """Ranges of the slices whose bytes come again whole."""
    both = contents.where("lo <> hi").select(F.struct("anchor", "content").alias("slice"), "lo")
    rows = lookup(found.withColumn("slice", F.struct("anchor", "content")), both, "slice", "inner")
    if keep_first:
        rows = rows.where(_place() > F.col("lo"))
    return rows.select("doc_id", "text_key", "first", (F.col("first") + F.col("count") - 1).alias("last"))


def _contents(found: DataFrame, *others: str) -> DataFrame:
    """(anchor, content, lo, hi): first and last place of every distinct slice."""
    return freeze(found.groupBy("anchor", "content").agg(
        F.min(_place()).alias("lo"), F.max(_place()).alias("hi"),
        *[F.min_by(c, _place()).alias(c) for c in others]), "contents")


def _unlike(contents: DataFrame, *others: str) -> DataFrame:
    """The first place of each distinct slice of an anchor that has several, and their number n."""
    mixed = contents.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    return lookup(contents, mixed, "anchor", "inner").select("anchor", "content", "n", "lo.*", *others)


def _borders(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Ranges of the repeated places in slices that differ, anchor by anchor."""
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(total // BUCKET_BYTES + 1))
    near = pieces.select(
        bucket.alias("bucket"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "first", "bytes")
    return near.groupBy("bucket").applyInArrow(
        _matched(length, keep_first), "doc_id long, text_key long, first int, last int")


def repeated_places(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, first, last): ranges of bytes from which ``length`` bytes are repeated."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    named = named.where(F.octet_length("text") >= length)
    found = freeze(named.mapInArrow(_slice_rows(length, gram), _SLICE), "slices")
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = freeze(lookup(found, often, "anchor", "inner"), "again")
    release(found)
    contents = _contents(again)
    wanted = _unlike(contents).groupBy(F.struct("doc_id", "text_key").alias("row")).agg(F.collect_list(F.struct(
        "first", "count", "anchor_at", "anchor", "content", (F.col("n") > group).alias("hot"))).alias("wanted"))
    keyed = named.withColumn("row", F.struct("doc_id", "text_key"))
    pieces = freeze(lookup(keyed, wanted, "row", "inner").mapInArrow(
        _cut(length), f"{_SLICE}, bytes binary, hot boolean"), "pieces")
    hot, rest = pieces.where("hot"), pieces.where("NOT hot")

    stretches = freeze(hot.select(_CUT.names).mapInArrow(_split(length, STEP), f"{_SLICE}, bytes binary"), "stretches")
    shorter = _contents(stretches, "bytes")
    unlike = freeze(_unlike(shorter, "bytes"), "unlike")
    single = unlike.where(F.col("n") > group).select(_CUT.names).mapInArrow(_split(length, 1), f"{_SLICE}, bytes binary")
    single = freeze(single.drop("bytes"), "windows")

    parts = [
        _whole(again, contents, keep_first),
        _borders(rest, length, keep_first),
        _whole(stretches, shorter, keep_first),
        _borders(unlike.where(F.col("n") <= group), length, keep_first),
        _whole(single, _contents(single), keep_first),
    ]
    return functools.reduce(DataFrame.union, parts)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _without():
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(span))])

    def run(batches):
        for batch in batches:
            ids, texts, found = (batch.column(c) for c in ("doc_id", "text", "spans"))
            out, held = [], 0
            for i in range(len(batch)):
                raw = (texts[i].as_py() or "").encode()
                spans = _merged(found[i].as_py() or [])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((ids[i].as_py(), kept, [{"start": a, "end": b} for a, b in spans]))
                held += len(kept)
                if held > arrays.BLOCK_BYTES:
                    yield _batch(out, schema)
                    out, held = [], 0
            if out:
                yield _batch(out, schema)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, kept, spans) of every row: its UTF-8 bytes without the repeated ones.

    A byte is removed if ``length`` bytes that cover it start at another place as well, in this or
    any other text; with ``keep_first`` only if that place comes before (smaller doc_id, nulls last,
    then text_key, then byte), so one copy stays. Strings are judged on the input, not on what is
    left, and never go from one text into the next. ``spans`` are the maximal removed (start, end)
    in bytes; ``kept`` is binary, since a span may end inside a character. Rows that agree in doc_id
    and text are one document: they do not repeat each other and get the same result. Null and
    empty texts give empty bytes and no span. Only ``doc_id`` and ``text`` are read, so other
    columns may have any name. A text is worked on whole, in memory in proportion to it. An empty
    table gives an empty result.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    ship(docs.sparkSession)
    places = repeated_places(docs, length, keep_first, gram, group)
    span = F.struct(F.col("first").cast("long").alias("start"), (F.col("last").cast("long") + length).alias("end"))
    spans = freeze(places.groupBy(F.struct("doc_id", "text_key").alias("row")).agg(
        F.collect_set(span).alias("spans")), "spans")
    rows = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key()).alias("row"), F.col("text").cast("string").alias("text"))
    joined = lookup(rows, spans.hint("merge"), "row")
    return joined.select(F.col("row.doc_id").alias("doc_id"), "text", "spans").mapInArrow(
        _without(), "doc_id long, kept binary, spans array<struct<start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, hash of the rest."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
