"""Line dedup by winnowing: runs of lines that occurred before are deleted.

A window is the shortest run of lines from a line on (and up to a line) that has ``MIN_WORDS``
words. From each window the least line hash is its fingerprint, so two texts that share a run of
so many words share a fingerprint inside it: no such run can be missed. Windows of one line count,
a long line being a run of its own.

Fingerprints that occur once are dropped after a count. The others are extended both ways: a
window is known by the hash of its lines, its first place in the corpus is a minimum, and every
later place is marked. Windows overlap, so the marks of a repeated run join to the whole run. No
pairs are formed: a line in a third of all documents costs one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.tables import let, text_key
from casework.operators.joins import lookup
from casework.workspace import freeze

MIN_WORDS = 50


def line_hashes(block: arrays.Block) -> tuple[np.ndarray, ...]:
    """The block's lines that have words: text, number in it, words, hash of the words.

    Last, the number of lines of each text.
    """
    not_break = np.ones(256, bool)
    not_break[0x0A] = False
    found = block.words(not_break)
    words = block.words(~arrays.SPACE)
    low, high = np.searchsorted(words.start, found.start), np.searchsorted(words.start, found.end)
    powers, inverse = arrays._table(len(words.hash) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hash * powers[: len(words.hash)], dtype=np.uint64)])
    hashes = arrays.mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))
    breaks = np.concatenate([[0], np.cumsum(block.data == 0x0A)])
    of = np.repeat(np.arange(len(block)), np.diff(found.of))
    number = breaks[found.start] - breaks[block.at[:-1][of]]
    used = high > low
    total = breaks[block.at[1:]] - breaks[block.at[:-1]] + 1
    return of[used], number[used], (high - low)[used], hashes[used], total


def windows(sizes: np.ndarray, least: int) -> np.ndarray:
    """Distinct (first, last) of the shortest runs from and up to each line with enough words."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    last = np.searchsorted(total, total[:-1] + least) - 1
    forward = np.stack([np.arange(n), last], 1)[last < n]
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    backward = np.stack([first, np.arange(n)], 1)[first >= 0]
    return np.unique(np.concatenate([forward, backward]), axis=0)


def _windows(least: int):
    fields = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()),
                        ("last", pa.int32()), ("fingerprint", pa.int64()), ("content", pa.int64())])

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                of, number, sizes, hashes, total = line_hashes(block)
                edges = np.searchsorted(of, np.arange(len(block) + 1))
                rows, firsts, lasts, prints, contents = [], [], [], [], []
                for i in range(len(block)):
                    part = slice(edges[i], edges[i + 1])
                    if sizes[part].sum() < least:
                        continue
                    h, starts = hashes[part], number[part]
                    ends = np.append(starts[1:], total[i]) - 1  # with the wordless lines after it
                    for a, b in windows(sizes[part], least):
                        rows.append(block.first + i)
                        firsts.append(starts[a])
                        lasts.append(ends[b])
                        prints.append(h[a : b + 1].min())
                        contents.append(arrays.sequence(h[a : b + 1])[0])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("text_key").take(take),
                     pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()),
                     *(pa.array(arrays.signed(np.array(x, np.uint64))) for x in (prints, contents))],
                    schema=fields)

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, runs): per document with deletions, its (first, last) line numbers to delete.

    ``row`` is (doc_id, text_key). The first place of a run is the one with the smallest doc_id
    (nulls last), then text_key, then line.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")
    found = freeze(
        named.mapInArrow(_windows(min_words), "doc_id long, text_key long, first int, last int, "
                         "fingerprint long, content long").distinct(), "lines")
    often = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = lookup(found, often, "fingerprint", "inner")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "first")
    content = F.struct("content", "fingerprint")
    firsts = again.groupBy(content.alias("content")).agg(
        F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = lookup(again.withColumn("content", content), firsts, "content", "inner").where(
        place > F.col("origin"))
    return later.groupBy(F.struct("doc_id", "text_key").alias("row")).agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeats of runs of lines deleted from ``text``, and ``n_deleted`` lines.

    Lines are compared by their words (white space aside); a line without a word goes with the
    line before it. A run may lie in the same text as its
    first occurrence. A text all of whose lines go is empty, the row stays. Rows that agree in
    doc_id and text are the same document: none is a repeat of the other, and all get the same
    result. Null texts stay null, with 0 deleted; null ids come after all others; other columns
    are kept, but for an ``n_deleted``, which the new one replaces. An empty table gives an empty
    result.
    """
    runs = freeze(repeated_runs(docs, min_words), "runs")
    keyed = docs.select(
        F.struct(*docs.columns).alias("all"),
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key()).alias("row"))
    out = lookup(keyed, runs.hint("merge"), "row")  # one plan at every size
    text = F.col("all").getField("text")
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    kept = let(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("runs").isNull(), 0).otherwise(F.size(gone))
    return out.select(
        *[F.when(F.col("runs").isNull(), text).otherwise(kept).alias("text") if c == "text"
          else F.col("all").getField(c).alias(c) for c in docs.columns if c != "n_deleted"],
        n.cast("long").alias("n_deleted"))
