"""Benchmark decontamination by winnowing, in built-in expressions only.

A window is ``SPAN`` consecutive words. Every run of ``GRAM`` words has a hash; from the
``SPAN - GRAM + 1`` runs in a window the least is its fingerprint, so two texts that share a window
share its fingerprint (Schleimer, Wilkerson and Aiken 2003). Documents meet the benchmark on the
distinct fingerprints first; only documents with a meeting are looked at again, and there each
fingerprint is extended to its whole window, which must agree in a second, independent hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.tables import let, text_key
from casework.operators.joins import lookup
from casework.workspace import freeze

SPAN, GRAM = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing


def words(text: str = "text") -> Column:
    """Lower-cased (A-Z only) words of a text; null has none."""
    c = F.coalesce(F.col(text), F.lit(""))
    plain = F.length(c) == F.octet_length(c)  # all ASCII, where lower() is the same and quick
    low = F.when(plain, F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def _shift(items: Column, n: int) -> Column:
    return F.slice(items, F.lit(n + 1), F.size(items))


def _sliding(items: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` folded over the n items from each item on, by doubling; the tail is short."""
    if n == 1:
        return items
    if n % 2 == 0:
        half = n // 2
        return let(_sliding(items, half, join), lambda x: F.zip_with(x, _shift(x, half), join))
    return F.zip_with(_sliding(items, n - 1, join), _shift(items, n - 1), join)


def grams(hashes: Column, n: int) -> Column:
    return _sliding(hashes, n, lambda a, b: F.xxhash64(a, b))


def _whole(values: Column, tokens: Column, span: int) -> Column:
    """Without the tail, whose windows run past the text."""
    return F.slice(values, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - (span - 1)))


def fingerprints(tokens: Column, span: int, gram: int) -> Column:
    """Per window of ``span`` words the least hash of its ``gram``-word runs."""
    def least(h: Column) -> Column:
        return let(grams(h, gram), lambda g: _sliding(
            g, span - gram + 1, lambda a, b: F.least(a, b)))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: _whole(least(h), tokens, span))


def window_checks(tokens: Column, span: int) -> Column:
    """Per window a hash of its words that shares nothing with the fingerprints."""
    seeded = F.transform(tokens, lambda w: F.xxhash64(w, F.lit(span)))
    return let(seeded, lambda h: _whole(grams(h, span), tokens, span))


def _windows(rows: DataFrame, key: str, span: int, gram: int) -> DataFrame:
    """(key, at, fingerprint, check) of every window."""
    both = let(F.col("tokens"), lambda t: F.zip_with(
        fingerprints(t, span, gram), window_checks(t, span),
        lambda f, c: F.struct(f.alias("fingerprint"), c.alias("check"))))
    out = rows.select(key, F.posexplode(both).alias("at", "w"))
    return out.select(key, "at", "w.fingerprint", "w.check")


def _hits(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """(row, at, span, fingerprint, check): windows of documents that are in ``wanted``."""
    prints = wanted.select("fingerprint").distinct()
    met = docs.select("row", F.explode(F.array_distinct(let(words(), lambda t: fingerprints(
        t, span, gram)))).alias("fingerprint"))
    rows = freeze(lookup(met, prints, "fingerprint", "inner").select("row").distinct(), "met")
    again = docs.join(rows.withColumnRenamed("row", "met_row"), F.col("row") == F.col("met_row"),
                      "left_semi").withColumn("tokens", words())
    found = _windows(again, "row", span, gram)
    whole = wanted.select("fingerprint", "check").distinct()
    return lookup(found, whole, ["fingerprint", "check"], "inner").select(
        "row", "at", F.lit(span).alias("span"), "fingerprint", "check").distinct()


def _covered(windows: Column) -> Column:
    """How many words lie inside any of the (at, span) windows, sorted by ``at``."""
    return F.aggregate(
        windows,
        F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n")),
        lambda s, w: F.struct(
            F.greatest(s["until"], w["at"] + w["span"]).alias("until"),
            (s["n"] + F.greatest(
                F.lit(0), w["at"] + w["span"] - F.greatest(s["until"], w["at"]))).alias("n")),
    )["n"]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, keep_key: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit if it lies inside an occurrence of a window of an item. An item of fewer than
    ``span`` words is one window; one without words (or null) has none. Null and empty texts have
    no words. Rows that agree in doc_id and text are the same document and get the same result;
    null ids are kept as they are. Items that share a window are all named; a null item_id marks
    words but names nothing. Empty tables and other columns are fine. ``keep_key`` adds text_key,
    which with doc_id names the row.
    """
    named = docs.select(F.col("doc_id"), text_key(), F.col("text"))
    named = named.select(F.struct("doc_id", "text_key").alias("row"), "text")
    tokens = freeze(
        benchmark.select("item_id", F.col("text").alias("item_text"))
        .withColumn("tokens", words("item_text")).select("item_id", "tokens")
        .where(F.size("tokens") > 0), "items")
    length = F.least(F.size("tokens"), F.lit(span))
    spans = sorted(r[0] for r in tokens.select(length).distinct().collect())  # span values at most
    hits = items = None
    for n in spans:
        run = gram if n == span else n
        wanted = _windows(tokens.where(length == n), "item_id", n, run).drop("at").distinct()
        wanted = freeze(wanted.withColumn("span", F.lit(n)), "windows")
        part = _hits(named, wanted, n, run)
        hits = part if hits is None else hits.union(part)
        items = wanted if items is None else items.union(wanted)
    counts = named.select("row", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD))
                          .cast("long").alias("n_words"))
    if hits is None:
        out = counts.withColumns({"n_hit": F.lit(0), "ids": F.array().cast("array<string>")})
    else:
        hits = freeze(hits, "hits")
        covered = hits.select("row", "at", "span").distinct().groupBy("row").agg(
            _covered(F.sort_array(F.collect_list(F.struct("at", "span")))).alias("n_hit"))
        window = ["fingerprint", "check", "span"]
        ids = lookup(hits.select("row", *window).distinct(), items, window, "inner")
        ids = ids.select("row", F.col("item_id").cast("string").alias("id")).distinct()
        ids = ids.where("id IS NOT NULL").groupBy("row").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        out = lookup(lookup(counts, covered, "row"), ids, "row")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0))
    return out.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), *(["row.text_key"] if keep_key else []))
