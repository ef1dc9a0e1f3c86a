"""Document rules, and host verdicts from shrunken failure rates.

Each rule is a yes or no on one whole text. For a host (``source``) with n documents of which f
fail a rule, f / n says little when n is small, so it is drawn towards the rate of all hosts: with
a beta prior (a, b) fitted to the hosts' rates by moments, the host's rate is (f + a) / (n + a + b).
A host whose rate for any rule passes ``HOST_LIMIT`` loses all its documents; else a document goes
by its own base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.operators.joins import lookup
from casework.workspace import freeze

SYMBOLS = arrays.byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
MIN_WORDS, REPEAT_PERCENT = 50, 50
HOST_LIMIT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """True where a document fails; ``short`` and ``repeats`` are the base rules."""
    n = F.greatest("n_words", F.lit(1))
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "lines": 3 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive places."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _first_seen(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether its key came before in its text, and whether it occurs twice in it."""
    mixed = arrays.mix(keys ^ arrays.mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return again, twice


def lines(block: arrays.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each \\n-separated line that is not empty."""
    is_line = np.ones(256, bool)
    is_line[0x0A] = False
    found = block.words(is_line)
    return found.start, found.end, found


def counts(block: arrays.Block) -> list[np.ndarray]:
    """COUNTS and the number of lines with a word, per text."""
    words = block.words(~arrays.SPACE)
    n = np.diff(words.of)
    data = block.data
    points = (data & 0xC0) != 0x80  # not inside a character
    chars = _per_text(points & ~arrays.SPACE[data], block.at)
    symbols = _per_text(SYMBOLS[data], block.at)

    starts, ends, found = lines(block)
    has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    of_line = np.repeat(np.arange(len(block)), np.diff(found.of))
    again, _ = _first_seen(found.hash, of_line)
    dup = _per_text(again & has_word, found.of)

    of = np.repeat(np.arange(len(block)), n)
    grams = words.grams(3)
    repeated = np.zeros(len(of), bool)
    if len(grams):
        inside = of[: len(grams)] == of[2:]
        at = np.flatnonzero(inside)
        _, twice = _first_seen(grams[at], of[at])
        for j in range(3):
            repeated[at[twice] + j] = True
    return [n, chars, symbols, dup, _per_text(repeated, words.of), _per_text(has_word, found.of)]


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, COUNTS, n_lines) of every row of ``docs``."""
    names = ["doc_id", "source", *COUNTS, "n_lines"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                kept = [batch.column(c).slice(block.first, len(block)).cast(k)
                        for c, k in zip(names, kinds[:2])]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(c.astype(np.int64)) for c in counts(block)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'source' else 'long'}" for c in names))


def host_rates(measured: DataFrame) -> DataFrame:
    """(source, n_docs, and the shrunken rate of every rule) per host.

    The prior's moments: with m and v the mean and variance of the hosts' raw rates, each host
    weighing alike, a + b = m (1 - m) / v - 1, and a = m (a + b). a + b counts as so many
    documents; it is held between 10, so that one document never condemns its host, and 1000, as
    hosts that all agree would make it infinite.
    """
    names = list(rules())
    hosts = measured.where("source IS NOT NULL").groupBy("source").agg(
        F.count("*").alias("n_docs"), *[F.sum(r.cast("long")).alias(k) for k, r in rules().items()])
    moments = hosts.agg(*[x for k in names for x in (
        F.avg(F.col(k) / F.col("n_docs")).alias(f"{k}_mean"),
        F.var_pop(F.col(k) / F.col("n_docs")).alias(f"{k}_var"))]).first()

    def rate(k: str) -> Column:
        m, v = moments[f"{k}_mean"] or 0.0, moments[f"{k}_var"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, 10.0), 1000.0) if v > 0 else 1000.0
        return ((F.col(k) + m * strength) / (F.col("n_docs") + strength)).alias(f"{k}_rate")

    return hosts.select("source", "n_docs", *[rate(k) for k in names])


def apply_host_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, host_failed) for every row of ``docs``.

    Words are runs of anything but ASCII white space; a repeated word lies in a 3-word window that
    the text holds twice; a duplicate line equals an earlier line and has a word. Null and empty
    texts have no words and fail. A null source is no host and has no verdict of its own. Repeated
    rows count as often as they come; null ids are rows like any other; an empty table gives an
    empty result.
    """
    measured = freeze(document_counts(docs), "counts")
    worst = F.greatest(*[F.col(f"{k}_rate") for k in rules()])
    hosts = host_rates(measured).select("source", (worst > limit).alias("host_failed"))
    base = rules()["short"] | rules()["repeats"]
    judged = lookup(measured.withColumn("base_failed", base), hosts, "source").withColumn(
        "host_failed", F.coalesce("host_failed", F.lit(False)))
    return judged.select(
        "doc_id", *COUNTS, "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed")
