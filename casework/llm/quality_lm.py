"""Quality classifier: interpolated modified Kneser-Ney models of trusted text.

The model that judges counts runs of words of all trusted documents in shards that grow in number with
the corpus, and every document's runs are looked up in them (``word_lm``): its perplexity. A mean over
words tells little of how unknown words are spelled, and a word model cannot: a second model does.

For spelling, text is read as symbols: 64 classes of bytes (letters, digit, upper case, punctuation,
…), so a run of four symbols is one of 64**4 at most. Its finished table has 64 MB whatever the
corpus, so it is broadcast and documents are scored where they lie. It gives a perplexity over
symbols, ``spelling``, and the excess, the mean of what each symbol's surprise has above ``PEAK``
bits. Perplexity is an average and blind to a few odd words in good text; the excess is not.

A document is rejected if one of the three is above the quantile of held-out trusted documents of
its own language, and that by a margin that shrinks as they grow.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.tables import text_key
from casework.llm.word_lm import train_words, word_perplexity
from casework.operators.joins import lookup
from casework.workspace import brief_shuffles, freeze, release

ORDER, BITS = 4, 6
CLASSES = 1 << BITS
PEAK = 8.0
PERPLEXITY_QUANTILE, EXCESS_QUANTILE = 0.995, 0.99
HELD_OUT = 3  # every third trusted document, by hash of its text, sets thresholds
MARGIN = 8.0  # few held-out documents know their quantile badly: so many standard errors on top
_PUNCTUATION = ".,'\"-():;?!/@"


def _classes() -> np.ndarray:
    """Class of each byte; 0 is before the text begins."""
    out = np.full(256, 31 + len(_PUNCTUATION), np.uint8)  # other ASCII marks
    out[arrays.SPACE], out[0x0A], out[:0x09] = 1, 2, 1
    out[0x0E:0x20] = 1
    out[0x41:0x5B], out[0x30:0x3A] = 3, 4
    out[0x61:0x7B] = np.arange(5, 31)
    for i, c in enumerate(_PUNCTUATION):
        out[ord(c)] = 31 + i
    out[0x80:] = 46 + (np.arange(0x80, 0x100) & 15)  # what follows a lead byte tells letters apart
    return out


_CLASS = _classes()


def runs(block: arrays.Block) -> np.ndarray:
    """For each byte the run of ORDER classes that ends there, as one number."""
    data = _CLASS[block.data].astype(np.uint32)
    out = data.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[: len(data) - back]
        starts = block.at[:-1][np.diff(block.at) > 0]
        for i in range(back):
            at = starts + i
            at = at[at < len(data)]
            before[at] = np.where(_same_text(block, at, back), before[at], 0)
        out |= before << np.uint32(BITS * back)
    return out


def _same_text(block: arrays.Block, at: np.ndarray, back: int) -> np.ndarray:
    text = np.searchsorted(block.at, at, side="right") - 1
    return at - back >= block.at[text]


def _count(batches):
    schema = pa.schema([("run", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for block in arrays.blocks(batch.column("text")):
            run, n = np.unique(runs(block), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(run.astype(np.int64)), pa.array(n)], schema=schema)


def _discounts(table: DataFrame) -> list[float]:
    """Amounts taken off counts of 1, 2 and 3 or more, from the counts of counts."""
    seen = {r.n: r.runs for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("runs")).collect()}
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    return [min(max(k - (k + 1) * y * b / a if a else k / 2, 0.1), k) for k, a, b in pairs]


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_ids all of whose labels say good quality and not toxic."""
    good = (F.min(F.col("quality")) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("trusted_id")).agg(
        good.alias("good")).where("good").select("trusted_id")


def _held_out() -> Column:
    return F.pmod(text_key(), F.lit(HELD_OUT)) == 0


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text) of all trusted documents that are not held out, found by one shuffle of the texts."""
    known = trusted_documents(labels).hint("merge")
    texts = docs.select("doc_id", "text").where(~_held_out())
    return texts.join(known, texts["doc_id"] == known["trusted_id"], "left_semi").select("text")


def train(docs: DataFrame, labels: DataFrame) -> list[DataFrame]:
    """Spelling, per order n: (run, p, context, weight), the probability of each run's last symbol.

    ``weight`` is what its context leaves to the order below. All trusted documents that are not
    held out count.
    """
    return train_spelling(trusted_texts(docs, labels))


def train_spelling(texts: DataFrame) -> list[DataFrame]:
    top = texts.mapInArrow(_count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    counts = [freeze(top, "runs")]
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("run").bitwiseAND(F.lit((1 << BITS * n) - 1))
        counts.insert(0, freeze(counts[0].groupBy(shorter.alias("run")).agg(F.count("*").alias("n")), "runs"))
    tables: list[DataFrame] = []
    for n, table in enumerate(counts, 1):
        d = _discounts(table)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = table.select("run", "n", off.alias("off"), F.shiftright("run", BITS).alias("context"))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        rows = lookup(rows, sums, "context", "inner").withColumn("weight", F.col("left") / F.col("total"))
        if tables:
            rows = rows.withColumn("suffix", F.col("run").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)))
            below = tables[-1].select(F.col("run").alias("suffix"), F.col("p").alias("below"))
            rows = lookup(rows, below, "suffix", "inner")
        else:
            rows = rows.withColumn("below", F.lit(1.0 / CLASSES))
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("below")
        tables.append(freeze(rows.select("run", p.alias("p"), "context", "weight"), "model"))
    return tables


class Model:
    """Surprise in bits of every run of ORDER classes: 64**4 numbers of 4 bytes."""

    def __init__(self, orders: list[tuple[np.ndarray, ...]]):
        self.orders, self._bits = orders, None

    def bits(self) -> np.ndarray:
        if self._bits is None:
            p = np.full(1, 1.0 / CLASSES, np.float32)
            for n, (run, known, context, weight) in enumerate(self.orders, 1):
                keep = np.ones(CLASSES ** (n - 1), np.float32)
                keep[context] = weight
                out = np.empty(CLASSES**n, np.float32)
                part = CLASSES ** max(n - 2, 0)  # contexts that begin with one symbol
                below = p if n > 1 else np.full(CLASSES, 1.0 / CLASSES, np.float32)
                for i in range(len(keep) // part):
                    left = np.repeat(keep[i * part : (i + 1) * part], CLASSES)
                    out[i * len(left) : (i + 1) * len(left)] = left * below
                out[run] = known
                p = out
            self._bits = np.maximum(p, 1e-9, out=p)
            np.negative(np.log2(p, out=p), out=p)
        return self._bits

    def __getstate__(self):
        return self.orders

    def __setstate__(self, orders):
        self.orders, self._bits = orders, None


def collect_model(tables: list[DataFrame]) -> Broadcast:
    """The model for every executor: 64 + 64**2 + 64**3 + 64**4 rows at most."""
    orders = []
    for table in tables:
        kept = table.toArrow()
        orders.append(tuple(
            kept.column(c).to_numpy().astype(np.int32 if c in ("run", "context") else np.float32)
            for c in ("run", "p", "context", "weight")))
    return tables[0].sparkSession.sparkContext.broadcast(Model(orders))


@lru_cache(maxsize=1)
def _table(held: Broadcast) -> np.ndarray:
    return held.value.bits()


def scores(model: Broadcast) -> Column:
    """struct(perplexity, excess) of ``text``; both null for a text without bytes."""
    kind = pa.struct([("perplexity", pa.float64()), ("excess", pa.float64())])

    @F.arrow_udf("struct<perplexity: double, excess: double>")
    def score(texts: pa.Array) -> pa.Array:
        bits, out = _table(model), [[], []]
        for block in arrays.blocks(texts):
            surprise = bits[runs(block)].astype(np.float64)
            n = np.diff(block.at).astype(float)
            for column, values in zip(out, (surprise, np.maximum(surprise - PEAK, 0))):
                total = np.concatenate([[0.0], np.cumsum(values)])
                with np.errstate(invalid="ignore", divide="ignore"):
                    column.append((total[block.at[1:]] - total[block.at[:-1]]) / n)
        mean, excess = (np.concatenate(c) if c else np.zeros(0) for c in out)
        none = np.isnan(mean)
        parts = [pa.array(np.exp2(mean), mask=none), pa.array(excess, mask=none)]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    return score("text")


_LIMITS = {"perplexity": PERPLEXITY_QUANTILE, "spelling": PERPLEXITY_QUANTILE, "excess": EXCESS_QUANTILE}


def thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(language, most_perplexity, most_spelling, most_excess) from the held-out trusted documents."""
    held = scored.where("held_out AND spelling IS NOT NULL")
    known = trusted_documents(labels)
    held = held.join(known, held["doc_id"] == known["trusted_id"], "left_semi")
    def limit(score: str, quantile: float) -> Column:
        error = F.stddev_pop(score) / F.sqrt(F.count(score))
        return (F.percentile_approx(score, quantile, 10_000) + MARGIN * error).alias(f"most_{score}")

    return held.groupBy("language").agg(*[limit(s, q) for s, q in _LIMITS.items()])


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _row() -> Column:
    """Names a row by all that a verdict rests on: rows that agree in it are judged alike."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _language(), text_key())


def _kept() -> Column:
    bad = F.lit(False)
    for score in _LIMITS:
        bad = bad | (F.col(score) > F.col(f"most_{score}"))
    return ~F.coalesce(bad, F.lit(False))


class Classifier:
    """The models and the limits, fitted to whole tables of documents and labels.

    Without ``by_words`` only spelling and excess judge, and ``perplexity`` is null.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, by_words: bool = True):
        with brief_shuffles(docs.sparkSession):
            self._fit(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, by_words)

    def _fit(self, docs: DataFrame, labels: DataFrame, by_words: bool) -> None:
        texts = freeze(trusted_texts(docs, labels), "trusted")
        self.model = collect_model(train_spelling(texts))
        self.words = train_words(texts) if by_words else None
        release(texts)
        spelled = docs.select(
            _row().alias("row"), "doc_id", _language().alias("language"), _held_out().alias("held_out"),
            scores(self.model).alias("s")).select(
                "row", "doc_id", "language", "held_out", F.col("s.perplexity").alias("spelling"), "s.excess")
        if by_words:
            words = word_perplexity(self.words, docs.select(_row().alias("row"), "text"))
            spelled = lookup(spelled, words, "row")
        else:
            spelled = spelled.withColumn("perplexity", F.lit(None).cast("double"))
        self.scored = freeze(spelled, "scores")
        self.limits = freeze(thresholds(self.scored, labels), "limits")

    def _judged(self) -> DataFrame:
        return lookup(self.scored, self.limits, "language").withColumn("kept", _kept())

    def verdicts(self) -> DataFrame:
        """(doc_id, language, perplexity, excess, kept, spelling) of the rows it was fitted to."""
        return self._judged().select("doc_id", "language", "perplexity", "excess", "kept", "spelling")

    def keep(self, docs: DataFrame) -> DataFrame:
        """Those of the rows it was fitted to that pass, unchanged."""
        bad = freeze(self._judged().where("NOT kept").select("row").distinct(), "rejected")
        rows = docs.select(F.struct(*docs.columns).alias("all"), _row().alias("row_key"))
        rows = rows.join(bad, F.col("row_key") == F.col("row"), "left_anti")
        return rows.select(*[F.col("all").getField(c).alias(c) for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, language, perplexity, excess, kept, spelling) of every row of ``docs``.

    ``perplexity`` is over words, ``spelling`` over symbols. A null or empty text has no scores and is
    kept, and one of white space has none over words; so is a document whose language (null being
    one of its own) has no held-out trusted document, as nothing is known against it. Labels that
    contradict each other are no trust; null ids have no label. Rows that share a doc_id are
    scored one by one. Without any trusted document every run is equally likely. Ties with a limit
    are kept. An empty table gives an empty result; other columns are ignored.
    """
    return Classifier(docs, labels).verdicts()
