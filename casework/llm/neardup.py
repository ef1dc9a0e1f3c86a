"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates.

1. Each text becomes its set of distinct word shingles. One hash per shingle fills ``BINS`` bins
   with minima (one permutation); an empty bin borrows from a bin chosen by a hash of its own
   number, tried until one is filled (optimal densification).
2. Texts with equal sets are one class, named by its smallest id. Only classes go on, so copies
   never meet each other.
3. Each band of a class is a bucket key. In a bucket every class is compared with one hub only, so
   a bucket of n gives n - 1 pairs. Links are confirmed on whole sets.
4. Connected components. The classes of buckets that still hold several are finished exactly: in
   the order from the rarest shingle on, two sets similar enough share one among their first few
   (prefix filter). Classes that share one, directly or through others, are a block, and in a
   block every class meets every other. Large blocks are cut into slices of bounded volume, and
   each two slices are compared in a task of their own. Nothing is left untested.

36 bands of 4 rows lose a pair at the threshold with probability 1e-11 if bins are independent. In a
small set they are not, many being borrowed from the same few, so sets of up to ``SMALL`` shingles
have 48 bands of 3 rows. Sets between ``LARGE`` and ``SMALL`` have both: two sets similar enough
differ in size by a fifth at most, so they share a kind of band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.components import components
from casework.operators.joins import lookup
from casework.workspace import freeze

SHINGLE, BINS = 5, 144
SMALL, LARGE = 400, 320  # LARGE <= 0.8 * SMALL
SMALL_ROWS, LARGE_ROWS = 3, 4
_TRIES = 1024
VOLUME = 1 << 18  # shingles of a slice; a task holds two slices
NUMBERS = 1 << 23  # of a matrix, when a cell is compared: slices may be many short texts


def _borrow_table() -> np.ndarray:
    """Row j: the bins that an empty bin j asks, in order."""
    h = arrays.mix(np.arange(1, BINS * _TRIES + 1, dtype=np.uint64))
    return (h % np.uint64(BINS)).astype(np.int64).reshape(BINS, _TRIES)


_BORROW = _borrow_table()


def shingle_set(words: arrays.Words, grams: np.ndarray, i: int, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of text i; fewer than k words are one shingle."""
    low, high = words.of[i], words.of[i + 1]
    if high == low:
        return np.zeros(0, np.uint64)
    if high - low < k:
        return arrays.sequence(words.hash[low:high])
    return np.unique(grams[low : high - k + 1])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum per bin of a non-empty sorted set, empty bins filled by borrowing."""
    bins = (shingles % np.uint64(BINS)).astype(np.int64)
    least, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    least[bins[::-1]] = shingles[::-1]  # the smallest comes last and stays
    full[bins] = True
    empty = np.flatnonzero(~full)
    out = least.copy()
    for tries in (32, _TRIES):
        if not len(empty):
            break
        asked = _BORROW[empty, :tries]
        hit = full[asked]
        found = hit.any(axis=1)
        out[empty[found]] = least[asked[found, hit[found].argmax(axis=1)]]
        empty = empty[~found]
    if len(empty):  # 1024 tries all failed: the next filled bin
        filled = np.flatnonzero(full)
        out[empty] = least[filled[np.searchsorted(filled, empty) % len(filled)]]
    return out


def band_keys(bins: np.ndarray, n_rows: int) -> np.ndarray:
    rows = bins.reshape(-1, n_rows)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) + np.uint64(n_rows << 32)
    for r in range(n_rows):
        key = arrays.mix(key + rows[:, r])
    return key


def bucket_keys(shingles: np.ndarray) -> np.ndarray:
    bins = signature(shingles)
    kinds = [r for r, fits in ((SMALL_ROWS, len(shingles) <= SMALL), (LARGE_ROWS, len(shingles) >= LARGE)) if fits]
    return np.concatenate([band_keys(bins, r) for r in kinds])


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                words = block.words(~arrays.SPACE, arrays.LOWER)
                grams = words.grams(k)
                n, a, b = (np.zeros(len(block), np.int64) for _ in range(3))
                bands = [np.zeros(0, np.int64)] * len(block)
                for i in range(len(block)):
                    s = shingle_set(words, grams, i, k)
                    if len(s):
                        n[i] = len(s)
                        a[i] = arrays.signed(s.sum(dtype=np.uint64, keepdims=True))[0]
                        b[i] = arrays.signed(arrays.mix(s).sum(dtype=np.uint64, keepdims=True))[0]
                        bands[i] = arrays.signed(bucket_keys(s))
                ids = batch.column("doc_id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array(a), pa.array(b), arrays.ragged(bands, pa.int64())],
                    schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                words = block.words(~arrays.SPACE, arrays.LOWER)
                grams = words.grams(k)
                sets = [arrays.signed(shingle_set(words, grams, i, k)) for i in range(len(block))]
                ids = batch.column("doc_id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, arrays.ragged(sets, pa.int64())], schema=schema)

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""
    left = lookup(pairs, sets.withColumnsRenamed({"node": "a", "items": "items_a"}), "a", "inner")
    both = lookup(left, sets.withColumnsRenamed({"node": "b", "items": "items_b"}), "b", "inner")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    return both.where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b")


def _pairs(stars: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of members (node) and hubs."""
    return stars.select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    ).where("a <> b").distinct()


def _stars(buckets: DataFrame) -> DataFrame:
    """Each bucket's members paired with its hub, the least id."""
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"))
    return _pairs(lookup(buckets, hubs, "bucket", "inner"))


def _open(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, component) of the classes in buckets of several components."""
    named = lookup(buckets, comps, "node").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return lookup(named, mixed.where("low < high").select("bucket"), "bucket", "inner").select("node", "component").distinct()


def _blocks(whole: DataFrame, percent: int) -> DataFrame:
    """(node, block) of classes that may be similar to one of another component.

    Shingles of one class only come first in the order, so of a prefix of n - need + 1 just the
    shared ones are looked at.
    """
    items = whole.select("part", "node", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = freeze(items.groupBy("item").agg(
        F.count("*").alias("n_parts"), F.min("component").alias("low"), F.max("component").alias("high"),
    ).where("n_parts > 1").select("item", "n_parts", (F.col("low") < F.col("high")).alias("mixed")), "shared")
    shared = lookup(items, often, "item", "inner").groupBy("part", "node", "component", "n").agg(
        F.sort_array(F.collect_list(F.struct("n_parts", "item", "mixed"))).alias("shared"))
    left = F.size("shared") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefix = freeze(
        shared.where(left > 0).select("node", "component", F.explode(F.slice("shared", F.lit(1), left)).alias("at"))
        .where("at.mixed").select("node", "component", "at.item"),
        "prefix")
    hubs = prefix.groupBy("item").agg(
        F.min("node").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    edges = _pairs(lookup(prefix, hubs.where("low < high").select("item", "hub"), "item", "inner"))
    return components(edges).withColumnRenamed("component", "block")


def _compare(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(cell: pa.Table) -> pa.Table:
        component = cell.column("component").to_numpy()
        if (component == component[0]).all():
            return schema.empty_table()
        node, own, items = cell.column("node").to_numpy(), cell.column("own").to_numpy(), cell.column("items").combine_chunks()
        size = items.value_lengths().to_numpy().astype(np.int64)
        _, item, times = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # only what two of them have is compared
        row, item = (x[times[item] > 1] for x in (np.repeat(np.arange(len(size)), size), item))
        item = number[item]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        low, high = (np.flatnonzero(own == cell.column(c)[0].as_py()) for c in ("low", "high"))
        out = [np.zeros((0, 2), np.int64)]
        rows, step = (max(1, min(2048, NUMBERS // max(n, 1))) for n in (len(high), len(size)))
        for first in range(0, len(low), rows):
            ours = low[first : first + rows]
            common = np.zeros((len(ours), len(high)), np.float32)  # whole numbers, exact up to 2**24
            for left in range(0, int(item[-1]) + 1 if len(item) else 0, step):
                part = slice(*np.searchsorted(item, [left, left + step]))
                holds = np.zeros((len(size), step), np.float32)
                holds[row[part], item[part] - left] = 1
                common += holds[ours] @ holds[high].T
            both = common.astype(np.int64)
            union = size[ours][:, None] + size[high][None, :] - both
            linked = (100 * both >= percent * union) & (component[ours][:, None] != component[high][None, :])
            i, j = np.nonzero(linked)
            out.append(np.sort(np.stack([node[ours[i]], node[high[j]]], 1), axis=1))
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    return run


def _remaining(buckets: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between classes of different components that share a bucket."""
    whole = freeze(
        lookup(sets, _open(buckets, comps), "node", "inner")
        .withColumn("part", F.struct("node", F.xxhash64("items"))).dropDuplicates(["part"]), "open")
    members = lookup(whole, _blocks(whole, percent), "node", "inner")
    sizes = members.groupBy("block").agg(F.ceil(F.sum(F.size("items")) / VOLUME).alias("slices"))
    sliced = lookup(members, sizes, "block", "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))
    cells = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "node", "component", "items")
    return cells.groupBy("block", "low", "high").applyInArrow(_compare(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, …).

    Two texts are linked when 100 * |A ∩ B| >= percent * |A ∪ B|; component_id is the smallest
    doc_id that links reach. Null or wordless texts have no shingles and stand alone. Rows that
    share a doc_id are one node, whatever their texts. A row without an id joins no group:
    component_id null, kept. Ties cannot arise, ids being compared whole; an empty table gives an
    empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = freeze(
        texts.mapInArrow(
            _signatures(shingle),
            "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"),
        "signatures")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]
    classes = usable.groupBy(*key).agg(F.min("doc_id").alias("node"))
    named = F.struct("set_a", "set_b", "n_shingles")
    members = lookup(
        usable.withColumn("set", named),
        classes.select(named.alias("set"), F.col("node").alias("doc_id")),
        ["set", "doc_id"], "inner",
    ).select(F.col("doc_id").alias("node"), F.explode(F.array_distinct("bands")).alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = freeze(lookup(members, full, "bucket", "inner").distinct(), "buckets")
    wanted = buckets.select("node").distinct()
    sets = freeze(
        texts.join(wanted.hint("merge"), texts["doc_id"] == wanted["node"], "left_semi")
        .mapInArrow(_sets(shingle), "node long, items array<long>")
        .where(F.size("items") > 0),
        "sets")

    # Rows that share an id are one node: link the classes its texts fall into.
    twice = usable.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y"))
    repeated = usable.join(twice.where("x <> y"), "doc_id", "left_semi")
    links = lookup(
        repeated.select("doc_id", named.alias("set")),
        classes.select(named.alias("set"), "node"), "set", "inner",
    ).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()

    links = freeze(links.union(_linked(_stars(buckets), sets, percent)).distinct(), "links")
    comps = components(links)
    found = freeze(_remaining(buckets, sets, comps, percent), "links")
    if not found.isEmpty():
        comps = components(links.union(found))

    whole = lookup(classes, comps, "node").select(
        named.alias("set"), F.coalesce("component", "node").alias("component_id"))
    out = lookup(rows.withColumn("set", F.when(F.col("n_shingles") > 0, named)), whole, "set")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
