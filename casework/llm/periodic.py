"""Periodic runs of words: Lyndon roots from the first phase of Baier's suffix sorter.

A run is a stretch of words with smallest period q that no neighbouring word extends. For one of
the two orders of the words (any order and its reverse) the longest Lyndon word at some place of
the run is q words long. So the longest Lyndon word at every place, under both orders, holds the
root of every run; extending it both ways while words q apart are equal gives the run itself.

Phase one of Baier's sorter groups suffixes by a common prefix, and takes the groups from the
greatest down: every member of a group lengthens the nearest place before it that lies in a
smaller group, by the group's own prefix. When a group is taken, its prefix is the longest Lyndon
word at its members. That is linear in the words.

Texts are first cut to where a run can be: inside a run, every stretch of ``_shared`` words occurs
again in the same text, so words outside such stretches are in none. What remains is exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.tables import let, ship

MIN_LENGTH, MIN_TIMES = 24, 3


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place; zeros part the sequences and stay 1.

    ``symbols`` begins with a zero; the others are positive.
    """
    at_symbol: dict[int, list[int]] = {}
    for place, symbol in enumerate(symbols):
        at_symbol.setdefault(symbol, []).append(place)
    members = [at_symbol[symbol] for symbol in sorted(at_symbol)]  # group 0 holds the zeros
    number = {symbol: i for i, symbol in enumerate(sorted(at_symbol))}
    group = [number[symbol] for symbol in symbols]
    size = [len(m) for m in members]
    reach = [1] * len(members)  # length of a group's common prefix
    below = [i - 1 for i in range(len(members))]
    above = [i + 1 for i in range(len(members))]
    left = list(range(len(symbols)))  # a taken place points on towards the nearest one not taken
    found = [1] * len(symbols)
    now = len(members) - 1
    while now > 0:
        if size[now]:
            taken = [i for i in members[now] if group[i] == now]
            step = reach[now]
            for i in taken:
                found[i] = step
                left[i] = i - 1
            before = []
            for i in taken:
                j = i
                while left[j] != j:
                    left[j] = j = left[left[j]]
                if group[j]:
                    before.append(j)
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in Counter(before).items():
                moves.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(moves, reverse=True):
                moved = moves[times, old]
                if len(moved) == size[old]:  # the group as a whole: it keeps its place
                    reach[old] += times * step
                    continue
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                reach.append(reach[old] + times * step)
                for j in moved:
                    group[j] = new
                below.append(old)
                above.append(above[old])
                below[above[old]] = above[old] = new
        now = below[now]
    return found


class _Equal:
    """How far equal stretches reach, by classes of all stretches of 1, 2, 4, … symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.classes = len(symbols), [symbols]
        width = 1
        while 2 * width <= self.n:
            low = self.classes[-1][: self.n - 2 * width + 1]
            high = self.classes[-1][width : self.n - width + 1]
            pairs, same = np.unique(low * np.int64(self.n + 1) + high, return_inverse=True)
            self.classes.append(same)
            if len(pairs) == len(same):  # all differ, and so do longer ones
                break
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols from places a and b on that are equal, a < b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            fits = np.flatnonzero(b + done + (1 << k) <= self.n)
            x, y = a[fits] + done[fits], b[fits] + done[fits]
            done[fits[self.classes[k][x] == self.classes[k][y]]] += 1 << k
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols before places a and b that are equal, a < b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            fits = np.flatnonzero(a - done - (1 << k) >= 0)
            x, y = a[fits] - done[fits] - (1 << k), b[fits] - done[fits] - (1 << k)
            done[fits[self.classes[k][x] == self.classes[k][y]]] += 1 << k
        return done


def runs_of(symbols: np.ndarray, least: int = MIN_LENGTH, times: int = MIN_TIMES) -> np.ndarray:
    """(start, length, period) of the runs with length >= max(least, times * period), in order.

    Zeros part the sequences; the first symbol and the last are zeros.
    """
    top = int(symbols.max(initial=0)) + 1
    zero = symbols == 0
    apart = symbols.astype(np.int64)  # for comparing, every zero is a symbol of its own
    apart[zero] = top + np.arange(np.count_nonzero(zero))
    _, apart = np.unique(apart, return_inverse=True)
    equal = _Equal(apart)
    out = []
    for order in (symbols, np.where(zero, 0, top - symbols)):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)
        place = np.flatnonzero(~zero & (np.arange(len(symbols)) + period < len(symbols)))
        place = place[apart[place] == apart[place + period[place]]]  # a root comes at least twice
        period = period[place]
        ahead = equal.forward(place, place + period)
        behind = equal.backward(place, place + period)
        length = behind + period + ahead
        kept = length >= np.maximum(least, times * period)
        out.append(np.stack([place - behind, length, period], 1)[kept])
    found = np.unique(np.concatenate(out), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _shared(least: int, times: int) -> int:
    """Words that any run has in common with itself one period on."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _candidates(words: arrays.Words, of: np.ndarray, width: int) -> np.ndarray:
    """Flags of the words in stretches of ``width`` words that come twice in a text."""
    flags = np.zeros(len(of), bool)
    grams = words.grams(width)
    if not len(grams):
        return flags
    inside = np.flatnonzero(of[: len(grams)] == of[width - 1 :])
    keys = arrays.mix(grams[inside] ^ arrays.mix(of[inside].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    edges = np.zeros(len(of) + 1, np.int64)
    twice = np.unique(inside[order[np.concatenate([same, same + 1])]])
    edges[twice] += 1
    edges[twice + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def block_runs(block: arrays.Block, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The text in the block and (start, length, period) of every run; starts count words."""
    words = block.words(~arrays.SPACE)
    of = np.repeat(np.arange(len(block)), np.diff(words.of))
    at = np.flatnonzero(_candidates(words, of, _shared(least, times)))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    raw, ids = block.data.tobytes(), {}
    named = [ids.setdefault(raw[a:b], len(ids) + 1)
             for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of[at]) > 0)]))
    shift = np.zeros(len(at), np.int64)
    shift[starts] = 1
    shift = np.cumsum(shift)  # one zero before each stretch
    symbols = np.zeros(len(at) + len(starts) + 1, np.int64)
    symbols[np.arange(len(at)) + shift] = named
    back = np.zeros(len(symbols), np.int64)
    back[np.arange(len(at)) + shift] = at
    found = runs_of(symbols, least, times)
    word = back[found[:, 0]]
    found[:, 0] = word - words.of[of[word]]
    order = np.lexsort((found[:, 2], found[:, 0], of[word]))
    return of[word][order], found[order]


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    words = text.split()
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs.tolist():
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist())


def _texts(least: int, times: int):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                of, found = block_runs(block, least, times)
                edges = np.searchsorted(of, np.arange(len(block) + 1))
                raw, at = block.data.tobytes(), block.at.tolist()
                texts = [
                    _collapsed(raw[at[i] : at[i + 1]], found[a:b]) if b > a else b" ".join(raw[at[i] : at[i + 1]].split())
                    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))]
                flat = pa.StructArray.from_arrays([pa.array(found[:, j]) for j in range(3)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)),
                     pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), flat, type=pa.list_(run_type)),
                     pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    return run


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH, times: int = MIN_TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs, and its text without the repeats.

    Words are the stretches between white space, numbered from 0. ``runs`` are (start, length,
    period) with length >= max(least, times * period), by start, then period. ``collapsed`` has the
    words joined by one space, without those that some run holds after its first period. Null,
    empty and wordless texts have no run and collapse to an empty text. Every row is judged by
    itself, so repeated rows give repeated results and null ids are kept; only ``doc_id`` and
    ``text`` are read, so other columns may have any name. A text of any length is worked on whole,
    in memory in proportion to it. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _texts(least, times),
        "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the CRC-32 of its id repeats a stretch of its words.

    Let h be that CRC-32, g = floor(h / 10), n the words. If h % 10 = 0 and n > 0, word i >= a is
    word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and
    those without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10)

    def periodic(words):
        n = F.size(words)
        spans = F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        return F.when(n > 0, let(spans, lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(
                i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " ")))

    words = F.filter(F.split(F.col("text"), "[ \\t-\\r]+", -1), lambda w: w != "")
    planted = F.coalesce(let(words, periodic), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the run of greatest length / period, and hashes of runs and text."""
    runs = F.col("runs")
    # Greatest length / period first, compared as products, then the smallest start and period.
    order = F.array_sort(runs, lambda a, b: F.coalesce(
        F.nullif(F.signum(b["length"] * a["period"] - a["length"] * b["period"]), F.lit(0.0)),
        F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)),
        F.signum(a["period"] - b["period"])).cast("int"))
    best = F.get(order, F.lit(0))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
