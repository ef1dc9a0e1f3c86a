"""Interpolated modified Kneser-Ney over words, as tables that grow with the corpus.

A text is its words and marks, between ``ORDER - 1`` starts and one end. Runs of ``ORDER`` words of
all trusted texts are counted; lower orders count in how many different ways a run continues to the
left (Chen and Goodman 1999). Nothing is folded into classes, dropped or limited in number.

The finished model is kept in back-off form. With left(h) the counts that a context h leaves to the
order below, log p(word | h) is the sum over orders of log left(h) / total(h), and of
log(1 + (n - discount) / (left(h) p')) where the run was seen n times, p' being the order below. So
every run of a document has one value, which is 0 for runs the model does not hold, and a document's
bits are a sum over its runs.

A run is named by 64 bits, which deal it to a shard; there is one for every ``A_SHARD`` words of
trusted text. Counting sends the runs of many texts to their shards, one row for each. Scoring does
the same with the runs of documents; a shard looks them up and returns what their documents gain, one
row for the documents that were sent together, and those rows are added up. Shards hold words and counts only, and so do the rows sent: the ``HOT`` most
frequent words at most go by their rank and the others by their hash, which takes a third of the
room of names and values; values are computed where a shard is read.

Two things of bounded size keep most runs from being sent, whatever they leave being sent: the
values of the ``HOT`` most frequent runs at most, which are added where the document lies, and a
Bloom filter of all runs the model holds. A filter too small for its model lets more through and
loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.operators.joins import lookup
from casework.workspace import freeze, release

ORDER = 2  # each further order counts and looks up as many runs again
HOT = 1 << 19  # words, and runs
A_SHARD = 1 << 20  # words of trusted text
CHUNK = 1 << 19  # runs sent together
BITS_A_RUN, LEAST_BITS, MOST_BITS = 10, 16, 28  # of the filter; the latter two as powers of two
_START, _END = (arrays.mix(np.array([x], np.uint64))[0] for x in (1, 2))
_MARKS = ~(arrays.SPACE | arrays.ALPHANUMERIC)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RARE = np.uint64(1 << 63)  # marks a hash, to tell it from a rank
_SHARD = "shard int, k int, a binary, b binary, c binary"


def sequences(block: arrays.Block, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, padded, and the text each belongs to; empty texts have none.

    A word is a run of letters and digits, A-Z as a-z, or of other marks.
    """
    kinds = [arrays.Words(block, arrays.ALPHANUMERIC, arrays.LOWER), arrays.Words(block, _MARKS, arrays.SAME)]
    start = np.concatenate([k.start for k in kinds])
    by_place = np.argsort(start)
    words = np.concatenate([k.hash for k in kinds])[by_place]
    n = np.diff(np.searchsorted(start[by_place], block.at))
    texts = np.flatnonzero(n)
    n = n[texts]
    out = np.full(len(words) + order * len(n), _START, np.uint64)
    ends = np.cumsum(n + order) - 1
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)) * order + order - 1, n)] = words
    out[ends] = _END
    return out, np.repeat(texts, n + order)


def _places(text: np.ndarray, order: int, back: int) -> np.ndarray:
    """Where a run may end: all but the first ``back`` items of each text."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    free = np.ones(len(text), bool)
    for i in range(back):
        free[first + i] = False
    return np.flatnonzero(free)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, compressed byte by byte, as most numbers are small."""
    size = len(columns[0])
    data = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(size, 8).T.tobytes() for c in columns)
    return size.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes | None, *kinds: type) -> list[np.ndarray]:
    if packed is None:
        return [np.zeros(0, k) for k in kinds]
    size = int.from_bytes(packed[:8], "little")
    data = pa.decompress(packed[8:], 8 * size * len(kinds), codec="zstd", asbytes=True)
    data = np.frombuffer(data, np.uint8).reshape(len(kinds), 8, size)
    return [np.ascontiguousarray(d.T).view(k).reshape(size) for d, k in zip(data, kinds)]


def _name(words: list[np.ndarray]) -> np.ndarray:
    """Name of each row of words; that of none is 0."""
    if not words:
        return np.zeros(1, np.uint64)
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = out * _STEP + w
    return arrays.mix(out)


def _shard_of(name: np.ndarray, shards: int) -> np.ndarray:
    return ((name >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and which of them, so ordered, are the first of equal ones."""
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        c = c[by]
        new[1:] |= c[1:] != c[:-1]
    return by, np.flatnonzero(new)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _codes(words: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hashes, rank = vocabulary
    at, known = _find(hashes, words)
    out = words | _RARE
    out[known] = rank[at[known]]
    return out


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs with its rows, in their order."""
    by = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[by], np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(at)):
        yield int(i), by[at[i] : at[i + 1]]


def _often(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _least(sizes: list[tuple[int, int]], hot: int) -> int | None:
    """The lowest level of frequency, of (level, rows), down to which no more than ``hot`` rows lie."""
    least, held = None, 0
    for level, n in sorted(sizes, reverse=True):
        held += n
        if held > hot:
            break
        least = level
    return least


def _most_frequent(table: DataFrame, hot: int, columns: list[str]) -> list[np.ndarray]:
    """Columns of the most frequent rows of a table with ``n``, ordered by the first column."""
    sizes = [(r.often, r.rows) for r in table.groupBy(_often(F.col("n")).alias("often")).agg(F.count("*").alias("rows")).collect()]
    least = _least(sizes, hot)
    kept = table.where(F.lit(False) if least is None else _often(F.col("n")) >= least).select(*columns).toArrow()
    out = [kept.column(c).to_numpy() for c in columns]
    out[0] = out[0].view(np.uint64)
    by = np.argsort(out[0])
    return [c[by] for c in out]


def _words(order: int):
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                word, n = np.unique(sequences(block, order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(arrays.signed(word)), pa.array(n)], schema=schema)

    return run


def _count(order: int, vocabulary: Broadcast, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("runs", pa.binary())])

    def send(held):
        columns = [np.concatenate(c) for c in zip(*held)]
        by, first = _distinct(columns)
        n = np.diff(first, append=len(by))
        columns = [c[by[first]] for c in columns]
        for shard, rows in _by_shard(_shard_of(_name(columns), shards), shards):
            packed = _pack(*(c[rows] for c in columns), n[rows])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                words, text = sequences(block, order)
                distinct, at = np.unique(words, return_inverse=True)
                words = _codes(distinct, vocabulary.value)[at]
                ends = _places(text, order, order - 1)
                held.append([words[ends - back] for back in range(order - 1, -1, -1)])
                size += len(ends)
                if size >= CHUNK:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    return run


def _merge(order: int):
    """The rows of a shard as one, with its number of runs and how many of them occur 1 to 4 times."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [_unpack(r.as_py(), *[np.uint64] * order, np.int64) for r in rows.column("runs")]
        columns = [np.concatenate(c) for c in zip(*parts)]
        n = columns.pop()
        by, first = _distinct(columns)
        n = np.add.reduceat(n[by], first)
        packed = _pack(*(c[by[first]] for c in columns), n)
        often = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        sizes = {"runs_in": [len(n)], **{f"n{i}": [int(x)] for i, x in enumerate(often, 1)}}
        sizes = {c: pa.array(v, pa.int64()) for c, v in sizes.items()}
        return pa.table({"shard": rows.column("shard").slice(0, 1), "runs": pa.array([packed], pa.binary()), **sizes})

    return run


def _columns(order: int) -> list[str]:
    return [f"run{k}" for k in range(1, order + 1)] + [f"context{k}" for k in range(2, order + 1)]


def _shorter(order: int):
    """Runs without their first word, with the number of different first words in this shard."""
    names = _columns(order - 1)

    def run(batches):
        for batch in batches:
            for runs in batch.column("runs"):
                words = _unpack(runs.as_py(), *[np.uint64] * order, np.int64)[1:order]
                by, first = _distinct(words)
                words = [w[by[first]] for w in words]
                held = [_name(words[-k:]) for k in range(1, order)] + [_name(words[-k:-1]) for k in range(2, order)]
                held = [*map(arrays.signed, held), np.diff(first, append=len(by))]
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=[*names, "n"])

    return run


def _contexts(order: int):
    """Each context of this shard, how often it occurs, and how many runs of count 1, 2 and more go on from it."""

    def run(batches):
        for batch in batches:
            for runs in batch.column("runs"):
                *words, n = _unpack(runs.as_py(), *[np.uint64] * order, np.int64)
                by, first = _distinct(words[:-1])
                n = n[by]
                held = [arrays.signed(_name([w[by[first]] for w in words[:-1]])), np.add.reduceat(n, first)]
                held += [np.add.reduceat((f(n)).astype(np.int64), first) for f in (lambda n: n == 1, lambda n: n == 2, lambda n: n > 2)]
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["context", "total", "n1", "n2", "n3"])

    return run


def _parts_of(words: list[np.ndarray]) -> list[np.ndarray]:
    """Names of each run without its last and without its first word."""
    size = len(words[0])
    return [np.resize(_name(part), size) if not part else _name(part) for part in (words[:-1], words[1:])]


def _missing(order: int, hot: Broadcast):
    """The names that this shard needs and that are not among the most frequent."""
    schema = pa.schema([("shard", pa.int32()), ("name", pa.int64())])

    def run(batches):
        for batch in batches:
            for shard, runs in zip(batch.column("shard"), batch.column("runs")):
                words = _unpack(runs.as_py(), *[np.uint64] * order, np.int64)[:order]
                name = np.unique(np.concatenate([np.unique(p) for p in _parts_of(words)]))
                name = arrays.signed(name[~_find(hot.value[0], name)[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), shard.as_py(), np.int32)), pa.array(name)], schema=schema)

    return run


def _finish(rows: pa.Table) -> pa.Table:
    """One row of all that a shard holds: runs, the rare of their parts, and shorter runs."""
    runs = [r for r in rows.column("runs").to_pylist() if r is not None]
    kind = rows.column("kind").to_numpy()
    name, x, y, n = (rows.column(c).fill_null(0).to_numpy() for c in ("name", "x", "y", "n"))
    packed = []
    for of, columns in ((1, (name, x, y)), (2, (name, x, n))):
        columns = [c[kind == of] for c in columns]
        by = np.argsort(columns[0].view(np.uint64))
        packed.append(_pack(*(c[by] for c in columns)))
    held = [runs[0] if runs else None, *packed]
    return pa.table({"shard": rows.column("shard").slice(0, 1), "k": pa.array([-1], pa.int32()),
                     **{c: pa.array([h], pa.binary()) for c, h in zip("abc", held)}})


def _held(a: bytes, b: bytes, c: bytes, order: int, hot: tuple, off: list[float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(name, value, n) of the runs of ``order`` words that a shard holds, and of its shorter ones."""
    *words, n = _unpack(a, *[np.uint64] * order, np.int64)
    rare = _unpack(b, np.uint64, float, float)
    parts = []
    for i, name in enumerate(_parts_of(words), 1):
        at, known = _find(hot[0], name)
        found = hot[i][at] if len(hot[0]) else np.zeros(len(name))
        at, _ = _find(rare[0], name[~known])
        if len(at):
            found[~known] = rare[i][at]
        parts.append(found)
    kept = n - np.array([0.0, *off])[np.minimum(n, 3)]
    value = np.log1p(kept / (parts[0] * parts[1])) / np.log(2)
    return [_name(words), value, n], _unpack(c, np.uint64, float, np.int64)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Amounts taken off counts of 1, 2 and 3 or more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    return [min(max(k - (k + 1) * y * b / a if a else k / 2, 0.1), k) for k, a, b in pairs]


def _discounts_of(table: DataFrame) -> list[float]:
    seen = {r.n: r.runs for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("runs")).collect()}
    return _discounts(*(seen.get(i, 0) for i in (1, 2, 3, 4)))


class WordModel:
    """``parts``, a row for each shard; ``base``, the bits of a word nothing is known of.

    ``words`` are the most frequent words with their ranks, ``hot`` what the most frequent parts of
    runs leave to the order below and have in it, ``off`` the discounts of the longest runs.
    """

    def __init__(self, parts: DataFrame | None, base: float, order: int, shards: int = 1,
                 words: Broadcast | None = None, hot: Broadcast | None = None, off: list[float] | None = None):
        self.parts, self.base, self.order, self.shards = parts, base, order, shards
        self.words, self.hot, self.off = words, hot, off

    def held(self):
        """For tasks: what a row of ``parts`` holds."""
        order, hot, off = self.order, self.hot, self.off
        return lambda a, b, c: _held(a, b, c, order, hot.value, off)

    @property
    def values(self) -> DataFrame | None:
        """(run, value, n) in bits; ``n`` tells how often a run is to be expected."""
        if self.parts is None:
            return None
        return self.parts.mapInArrow(_values(self.held(), 0), "run long, value double, n long")


def _values(held, least: int):
    """Runs to be expected at least so often."""

    def run(batches):
        for batch in batches:
            for a, b, c in zip(*(batch.column(x) for x in "abc")):
                for name, value, n in held(a.as_py(), b.as_py(), c.as_py()):
                    kept = n >= least
                    out = [arrays.signed(name[kept]), value[kept], n[kept]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["run", "value", "n"])

    return run


def train_words(texts: DataFrame, order: int = ORDER, hot: int = HOT, a_shard: int = A_SHARD) -> WordModel:
    """The model of ``texts`` (text); without any word every word is equally likely."""
    spark, texts = texts.sparkSession, texts.select("text")
    words = freeze(texts.mapInArrow(_words(order), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = words.agg(F.sum("n")).first()[0]
    if not size:
        return WordModel(None, 1.0, order)
    shards = -(-size // a_shard)
    hashes, n = _most_frequent(words, hot, ["word", "n"])
    rank = np.empty(len(n), np.uint64)
    rank[np.lexsort([hashes, -n])] = np.arange(len(n), dtype=np.uint64)
    release(words)
    vocabulary = spark.sparkContext.broadcast((hashes, rank))

    rows = texts.mapInArrow(_count(order, vocabulary, shards), "shard int, runs binary").groupBy("shard")
    sizes = ["runs_in", "n1", "n2", "n3", "n4"]
    longest = freeze(rows.applyInArrow(_merge(order), "shard int, runs binary, " + ", ".join(f"{s} long" for s in sizes)), "word_runs")
    whole = longest.agg(*[F.sum(s).alias(s) for s in sizes]).first()
    off = _discounts(*(whole[s] for s in sizes[1:]))
    if order == 1:
        spent = whole.n1 * off[0] + whole.n2 * off[1] + (whole.runs_in - whole.n1 - whole.n2) * off[2]
        grams, base = None, _base(spent / size, whole.runs_in)
        common = (np.zeros(1, np.uint64), np.array([spent]), np.array([1.0 / (whole.runs_in + 1)]))
    else:
        grams, lower, base = _lower(longest, order, off)
        common = _most_frequent(grams, hot, ["name", "remain", "below"])
    common = spark.sparkContext.broadcast(common)

    rows = longest.select("shard", "runs", *_nothing(kind=0, name=None, x=None, y=None, n=None))
    if grams is not None:
        missing = longest.select("shard", "runs").mapInArrow(_missing(order, common), "shard int, name long")
        rare = lookup(missing, grams, "name", "inner")
        rows = rows.unionByName(rare.select("shard", *_nothing(runs=None, kind=1), "name", F.col("remain").alias("x"), F.col("below").alias("y"), *_nothing(n=None)))
        shard = F.pmod(F.shiftrightunsigned("run", 32), F.lit(shards)).cast("int").alias("shard")
        rows = rows.unionByName(lower.select(shard, *_nothing(runs=None, kind=2), F.col("run").alias("name"), F.col("value").alias("x"), *_nothing(y=None), "n"))
    parts = freeze(rows.groupBy("shard").applyInArrow(_finish, _SHARD), "word_model")
    for table in (longest, grams, lower) if grams is not None else (longest,):
        release(table)
    return WordModel(parts, base, order, shards, vocabulary, common, off)


def _base(weight: float, words: int) -> float:
    return -float(np.log2(weight / (words + 1)))


_KINDS = {"runs": "binary", "kind": "int", "name": "long", "x": "double", "y": "double", "n": "long"}


def _nothing(**given) -> list[Column]:
    return [F.lit(v).cast(_KINDS[c]).alias(c) for c, v in given.items()]


def _lower(longest: DataFrame, order: int, off: list[float]) -> tuple[DataFrame, DataFrame, float]:
    """What the orders below the last hold, and the bits of an unknown word.

    (name, remain, below, n) of runs of ``order - 1`` words: the counts they leave as a context to the
    order below, and their probability. (run, value, n) of all shorter runs.
    """
    names = _columns(order - 1)
    rows = longest.select("runs").mapInArrow(_shorter(order), ", ".join(f"{c} long" for c in [*names, "n"]))
    counts = [freeze(_grouped(rows, order - 1, F.sum("n")), "word_runs")]
    for k in range(order - 2, 0, -1):
        counts.insert(0, freeze(_grouped(counts[0], k, F.count("*")), "word_runs"))
    whole = counts[0].agg(F.count("*").alias("words"), F.sum("n").alias("total")).first()
    uniform, below, base, spent, values = 1.0 / (whole.words + 1), None, 0.0, list(counts), []
    for k, table in enumerate(counts, 1):
        d = _discounts_of(table)
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        if k == 1:
            weight = table.agg(F.sum(less)).first()[0] / whole.total
            base = _base(weight, whole.words)
            rows = table.withColumn("rest", F.lit(weight * uniform)).withColumn("total", F.lit(whole.total))
        else:
            context = f"context{k}"
            sums = freeze(table.groupBy(context).agg(
                F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("weight")), "word_contexts")
            spent.append(sums)
            values.append(sums.select(F.col(context).alias("run"), F.log2("weight").alias("value"), F.col("total").alias("n")))
            rows = lookup(table.select(f"run{k}", f"run{k - 1}", context, "n"), below, f"run{k - 1}", "inner")
            rows = lookup(rows.drop(f"run{k - 1}"), sums, context, "inner").withColumn("rest", F.col("weight") * F.col("below"))
        p = (F.col("n") - less) / F.col("total") + F.col("rest")
        rows = rows.select(F.col(f"run{k}").alias("run"), F.log2(p / F.col("rest")).alias("value"), "n", p.alias("below"))
        rows = freeze(rows, "word_model")
        spent.append(rows)
        values.append(rows.drop("below"))
        below = rows.select(F.col("run").alias(f"run{k}"), "below")
    sums = longest.select("runs").mapInArrow(_contexts(order), "context long, total long, n1 long, n2 long, n3 long")
    remain = sum((F.sum(c) * d for c, d in zip(("n1", "n2", "n3"), off)), F.lit(0.0))
    sums = freeze(sums.groupBy("context").agg(F.sum("total").alias("total"), remain.alias("remain")), "word_contexts")
    spent.append(sums)
    values.append(sums.select(F.col("context").alias("run"), F.log2(F.col("remain") / F.col("total")).alias("value"), F.col("total").alias("n")))
    none = F.lit(0.0)
    grams = sums.select(F.col("context").alias("name"), "remain", none.alias("below"), F.col("total").alias("n"))
    grams = grams.unionByName(rows.select(F.col("run").alias("name"), none.alias("remain"), "below", "n"))
    grams = freeze(grams.groupBy("name").agg(*[F.max(c).alias(c) for c in ("remain", "below", "n")]), "word_parts")
    both = values[0]  # a run that is also a context has both values
    for part in values[1:]:
        both = both.unionByName(part)
    both = freeze(both.groupBy("run").agg(F.sum("value").alias("value"), F.max("n").alias("n")), "word_lower")
    for table in spent:
        release(table)
    return grams, both, base


def _grouped(rows: DataFrame, k: int, n: Column) -> DataFrame:
    """Runs of k words with their count and the names of their own parts, which the run determines."""
    parts = [c for c in _columns(k) if c != f"run{k}"]
    return rows.groupBy(f"run{k}").agg(n.alias("n"), *[F.first(c).alias(c) for c in parts])


def _places_in(bits: int, name: np.ndarray, shards: int) -> list[np.ndarray]:
    """Numbers of the bits that stand for a run, in a filter with so many for each shard."""
    first = _shard_of(name, shards) * bits
    return [first + (x & np.uint64(bits - 1)).astype(np.int64) for x in (name, arrays.mix(name))]


def _levels(held):
    def run(batches):
        for batch in batches:
            for a, b, c in zip(*(batch.column(x) for x in "abc")):
                for _, _, n in held(a.as_py(), b.as_py(), c.as_py()):
                    rows = np.bincount(np.frexp(n.astype(float))[1] - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows)], names=["often", "rows"])

    return run


def _mark(held, bits: int):
    def run(batches):
        for batch in batches:
            for shard, *parts in zip(*(batch.column(x) for x in ("shard", *"abc"))):
                filter_ = np.zeros(bits >> 6, np.uint64)
                for name, _, _ in held(*(p.as_py() for p in parts)):
                    for at in _places_in(bits, name, 1):
                        np.bitwise_or.at(filter_, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()], pa.int32()), pa.array([filter_.tobytes()], pa.binary())], names=["shard", "filter"])

    return run


def _shortcut(model: WordModel, hot: int, most_bits: int) -> Broadcast:
    """The most frequent runs, sorted, their values, and a Bloom filter of all runs, shard by shard."""
    sizes = model.parts.mapInArrow(_levels(model.held()), "often long, rows long")
    sizes = [(r.often, r.rows) for r in sizes.groupBy("often").agg(F.sum("rows").alias("rows")).collect() if r.rows]
    least, total = _least(sizes, hot), sum(n for _, n in sizes)
    run, value = np.zeros(0, np.uint64), np.zeros(0)
    if least is not None:
        table = model.parts.mapInArrow(_values(model.held(), 1 << least), "run long, value double, n long").select("run", "value").toArrow()
        run, value = table.column("run").to_numpy().view(np.uint64), table.column("value").to_numpy()
    by = np.argsort(run)
    power = min(max(int(total * BITS_A_RUN).bit_length(), LEAST_BITS), most_bits)
    bits = 1 << max(6, power - (model.shards - 1).bit_length())
    marked = model.parts.mapInArrow(_mark(model.held(), bits), "shard int, filter binary").toArrow()
    filter_ = np.zeros((model.shards, bits >> 6), np.uint64)
    for shard, part in zip(marked.column("shard").to_pylist(), marked.column("filter")):
        filter_[shard] = np.frombuffer(part.as_buffer(), np.uint64)
    return model.parts.sparkSession.sparkContext.broadcast((run[by], value[by], filter_.reshape(-1), bits))


class _Sheet:
    """Runs of some texts that are to be sent, and what the texts have without them."""

    schema = pa.schema([("shard", pa.int32()), ("k", pa.int32()), *((c, pa.binary()) for c in "abc")])

    def __init__(self, order: int, shards: int):
        self.order, self.shards = order, shards
        self.row, self.gained, self.n_words, self.asked, self.rows, self.size = [], [], [], {}, 0, 0

    def add(self, row: np.ndarray, gained: np.ndarray, n_words: np.ndarray) -> None:
        self.row.append(row), self.gained.append(gained), self.n_words.append(n_words)
        self.rows += len(row)
        self.size += len(row)

    def ask(self, k: int, columns: list[np.ndarray], own: np.ndarray) -> None:
        """Runs as their words if they have ``order`` of them, else by name, with their texts of those next added."""
        self.asked.setdefault(k == self.order, []).append([*columns, own.astype(np.uint64) + np.uint64(self.rows)])
        self.size += len(own)

    def send(self) -> Iterator[pa.RecordBatch]:
        row = np.concatenate(self.row)
        sheet = int(arrays.sequence(row.view(np.uint64))[0] >> np.uint64(1))  # depends on the texts only
        whole = [row, np.concatenate(self.gained), np.concatenate(self.n_words)]
        yield self._line(-1 - sheet % (1 << 30), 0, sheet, whole)
        for longest, held in self.asked.items():
            columns = [np.concatenate(c) for c in zip(*held)]
            by, first = _distinct(columns)
            n = np.diff(first, append=len(by))
            *columns, own = [c[by[first]] for c in columns]
            name = _name(columns) if longest else columns[0]
            for shard, rows in _by_shard(_shard_of(name, self.shards), self.shards):
                yield self._line(shard, 1 + longest, sheet, [*(c[rows] for c in columns), own[rows], n[rows]])

    def _line(self, shard: int, k: int, sheet: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        held = [[shard], [k], [sheet.to_bytes(8, "little")], [_pack(*columns)], [None]]
        return pa.RecordBatch.from_arrays([pa.array(h, f.type) for h, f in zip(held, self.schema)], schema=self.schema)


def _ask(order: int, shards: int, words: Broadcast | None, shortcut: Broadcast | None):
    def run(batches):
        hot, value, filter_, bits = shortcut.value if shortcut else (np.zeros(0, np.uint64), np.zeros(0), None, 0)
        sheet = _Sheet(order, shards)
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                hashes, text = sequences(block, order)
                row = batch.column("row").slice(block.first, len(block)).to_numpy()
                gained = np.zeros(len(block))
                distinct, which = np.unique(hashes, return_inverse=True)
                codes = _codes(distinct, words.value) if shortcut else distinct
                for k in range(1, order + 1) if shortcut else ():
                    ends = _places(text, order, order - 1 - (k < order))
                    own = text[ends]
                    parts = [codes[which[ends - back]] for back in range(k - 1, -1, -1)]
                    name = _name([codes]) if k == 1 else _name(parts)
                    held = np.ones(len(name), bool)
                    for at in _places_in(bits, name, shards):
                        held &= (filter_[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    some = np.flatnonzero(held)
                    at, known = _find(hot, name[some])
                    worth = np.zeros(len(name))
                    worth[some[known]] = value[at[known]]
                    held[some[known]] = False
                    if k == 1:
                        name, held, worth = (x[which[ends]] for x in (name, held, worth))
                    gained += np.bincount(own, worth, len(block))
                    sheet.ask(k, [p[held] for p in parts] if k == order else [name[held]], own[held])
                n = np.maximum(np.bincount(text, minlength=len(block)) - order + 1, 0)
                sheet.add(row, gained, n)
                if sheet.size >= CHUNK:
                    yield from sheet.send()
                    sheet = _Sheet(order, shards)
        if sheet.rows:
            yield from sheet.send()

    return run


def _answer(order: int, held):
    """What texts gain by the runs that were sent to a shard; lines of k = 0 only hold what they have."""
    schema = pa.schema([("sheet", pa.int64()), ("whole", pa.bool_()), ("packed", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        lines = sorted(rows.to_pylist(), key=lambda line: line["k"])
        tables, out = [(np.zeros(0, np.uint64), np.zeros(0))] * 2, []
        for line in lines:
            if line["k"] == -1:
                tables = []
                for name, value, _ in reversed(held(line["a"], line["b"], line["c"])):
                    by = np.argsort(name)
                    tables.append((name[by], value[by]))
                continue
            packed = line["b"]
            if line["k"]:
                longest = line["k"] == 2
                *words, text, n = _unpack(packed, *[np.uint64] * (order if longest else 1), np.int64, np.int64)
                names, values = tables[longest]
                at, known = _find(names, _name(words) if longest else words[0])
                if not known.any():
                    continue
                text, which = np.unique(text[known], return_inverse=True)
                packed = _pack(text, np.bincount(which, n[known] * values[at[known]]))
            out.append((int.from_bytes(line["a"], "little"), not line["k"], packed))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, schema)], schema=schema)

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """The texts of a sheet with all they gain; sheets that agree in their rows are the same texts."""
    own = [p.as_py() for w, p in zip(rows.column("whole"), rows.column("packed")) if w.as_py()]
    row, gained, n_words = _unpack(own[0], np.int64, float, np.int64)
    gained = len(own) * gained
    for whole, packed in zip(rows.column("whole"), rows.column("packed")):
        if not whole.as_py():
            text, more = _unpack(packed.as_py(), np.int64, float)
            gained[text] += more  # a text comes once in a line
    return pa.table([pa.array(row), pa.array(gained), pa.array(len(own) * n_words)], names=["row", "gained", "n_words"])


def word_perplexity(model: WordModel, docs: DataFrame, hot: int = HOT, most_bits: int = MOST_BITS) -> DataFrame:
    """(row, perplexity) of ``docs`` (row long, text); texts without a word are left out.

    ``row`` names a text: rows that agree in it are the same text. The end of a text is a word too.
    """
    known = _shortcut(model, hot, most_bits) if model.parts is not None else None
    lines = docs.select("row", "text").mapInArrow(_ask(model.order, model.shards, model.words, known), _SHARD)
    if model.parts is not None:
        lines = lines.unionByName(model.parts)
    found = lines.groupBy("shard").applyInArrow(_answer(model.order, model.held()), "sheet long, whole boolean, packed binary")
    sums = found.groupBy("sheet").applyInArrow(_add_up, "row long, gained double, n_words long")
    sums = sums.groupBy("row").agg(F.sum("gained").alias("gained"), F.sum("n_words").alias("n_words"))
    bits = F.lit(model.base) - F.col("gained") / F.col("n_words")
    return sums.where("n_words > 0").select("row", F.exp(bits * float(np.log(2))).alias("perplexity"))
