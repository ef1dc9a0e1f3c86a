"""Spelling variants: words one insertion, deletion or replacement apart, by permuterm rotations.

A word is closed by a mark, and all rotations of it are the strings that start at each of its
places, run to the mark and go on from the front. Let the edited place come last: the rotation
then reads ``after mark before edited``, and leaving the edited character out gives a prefix that
every word with another character there shares (replacement), and that is a whole rotation of the
word without it (deletion, and seen from the other side insertion). So all rotations, and each of
them without its last character, are grouped by that string. A group has at most one whole
rotation, and one member per character of the alphabet, so none is large, whatever the corpus.

A pair that a replacement links meets in one group only. A pair linked by an indel would meet once
for each of a run of equal characters; only the first place of such a run is used, so the counts
need no list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays
from casework.llm.tables import let, ship
from casework.sources.numbering import dense_numbers
from casework.workspace import freeze, release

MIN_LENGTH, MIN_COUNT = 5, 3
MARK = "$"  # in no word
LONG = 64  # code points; the strings of longer words are grouped by their SHA-256
TYPO_EVERY = 97
HELD = 1 << 18  # distinct words a task holds before it hands them on
_LETTER = arrays.byte_set((0x41, 0x5A), (0x61, 0x7A))

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1).astype(np.uint32)


def crc_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte runs, each going on from the (finished) CRC in ``state``."""
    out = ~state.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    left = size[order]
    for step in range(int(size.max(initial=0))):
        live = order[: np.searchsorted(-left, -step, side="left")]
        byte = data[start[live] + step]
        out[live] = _crc[(out[live] ^ byte) & np.uint32(0xFF)] ^ (out[live] >> np.uint32(8))
    return ~out


def letter_runs(block: arrays.Block) -> arrays.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (0xC3 and a byte after it); A-Z folded."""
    lead = block.data == 0xC3
    inside = _LETTER[block.data] | lead
    inside[1:] |= lead[:-1]
    return arrays.Words(block, inside, arrays.LOWER, masked=True)


def _dropped(word: bytes, crc: int) -> bytes:
    text = word.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counted(typos: bool):
    """Arrow batches of (doc_id, text) to (word, n) of the whole task, in pieces."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for block in arrays.blocks(batch.column("text")):
                words = letter_runs(block)
                if not len(words.start):
                    continue
                of = np.repeat(np.arange(len(block)), np.diff(words.of))
                data = arrays.LOWER[block.data]
                size = words.end - words.start
                lengths = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                points = lengths[words.end] - lengths[words.start]
                hit = np.zeros(len(of), bool)
                if typos:
                    heads = [b"" if i is None else b"%d" % i for i in ids[block.first : block.first + len(block)]]
                    heads = [h + b":" for h in heads]
                    flat = np.frombuffer(b"".join(heads), np.uint8)
                    head_size = np.array([len(h) for h in heads])
                    begin = np.cumsum(head_size) - head_size
                    state = crc_after(np.zeros(len(heads), np.uint32), flat, begin, head_size)
                    crc = crc_after(state[of], data, words.start, size)
                    hit = crc % np.uint32(TYPO_EVERY) == 0
                found = np.flatnonzero((points >= MIN_LENGTH) & ~hit)
                _, first, n = np.unique(words.hash[found], return_index=True, return_counts=True)
                first = found[first]
                raw = data.tobytes()
                for a, b, k in zip(words.start[first].tolist(), words.end[first].tolist(), n.tolist()):
                    word = raw[a:b]
                    held[word] = held.get(word, 0) + k
                for i in np.flatnonzero(hit & (points > MIN_LENGTH)).tolist():
                    word = _dropped(raw[words.start[i] : words.end[i]], int(crc[i]))
                    held[word] = held.get(word, 0) + 1
                if len(held) > HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    return run


def count_words(docs: DataFrame, typos: bool = False) -> DataFrame:
    """(word, n) of the words with at least MIN_LENGTH code points and MIN_COUNT occurrences.

    ``typos`` deletes one code point of every run whose CRC-32 with its doc_id (a null id is an
    empty string) is a multiple of TYPO_EVERY, as the query's contract asks.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= MIN_LENGTH)
    return rows.mapInArrow(_counted(typos), "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _rotations(word: Column) -> Column:
    """Every rotation of ``word`` and its mark, whole and without the last character.

    Structs of key, whole (a whole rotation) and first (no equal character right before the one
    left out; true for whole rotations).
    """
    def entry(key: Column, whole: Column, first: Column) -> Column:
        key = F.when(F.length(key) <= LONG, key).otherwise(F.sha2(key, 256))
        return F.struct(key.alias("key"), whole.alias("whole"), first.alias("first"))

    def at(i: Column, n: Column) -> Column:
        return F.substr(word, i, n)

    n = F.length(word)
    whole = F.transform(F.sequence(F.lit(0), n), lambda i: entry(
        F.concat(at(i + 1, n), F.lit(MARK), at(F.lit(1), i)), F.lit(True), F.lit(True)))
    without = F.transform(F.sequence(F.lit(1), n), lambda i: entry(
        F.concat(at(i + 1, n), F.lit(MARK), at(F.lit(1), i - 1)), F.lit(False),
        (i == 1) | (at(i, F.lit(1)) != at(i - 1, F.lit(1)))))
    return F.concat(whole, without)


def _neighbours(ranked: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words with near words; ids order words from the best on."""
    rows = ranked.select("id", F.explode(_rotations(F.col("word"))).alias("r")).select("id", "r.*")
    member = F.struct("id", "whole", "first")
    groups = rows.groupBy("key").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)

    def scan(members: Column) -> Column:
        """The near words that a group gives each of its members."""
        edited = F.filter(members, lambda m: ~m["whole"])
        whole = F.filter(members, lambda m: m["whole"])
        return let(F.struct(
            F.array_sort(F.transform(edited, lambda m: m["id"])).alias("edited"),
            F.array_sort(F.transform(F.filter(edited, lambda m: m["first"]), lambda m: m["id"])).alias("firsts"),
            F.get(F.transform(whole, lambda m: m["id"]), F.lit(0)).alias("whole")), lambda g: F.transform(
            members, lambda m: F.when(m["whole"], F.struct(
                m["id"].alias("id"), F.size(g["firsts"]).alias("n"), F.get(g["firsts"], F.lit(0)).alias("best"),
            )).otherwise(F.struct(
                m["id"].alias("id"),
                (F.size(g["edited"]) - 1 + (m["first"] & g["whole"].isNotNull()).cast("int")).alias("n"),
                F.least(
                    F.when(F.get(g["edited"], F.lit(0)) != m["id"], F.get(g["edited"], F.lit(0)))
                    .otherwise(F.get(g["edited"], F.lit(1))),
                    F.when(m["first"], g["whole"])).alias("best")))))

    near = groups.select(F.explode(scan(F.col("all"))).alias("m")).select("m.*").where("n > 0")
    return near.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(id, root) for links (id, form): each turn doubles the way, so a chain needs few turns."""
    now = freeze(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        turned = freeze(now.join(step, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        now = turned.select("id", "root")
        if turned.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, typos: bool = False, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word counted in ``text``.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n
    is at least ``ratio`` (2 or more, so that forms make no circle) times its own, else null; root
    follows forms to the last. Null, empty and wordless texts count nothing; equal rows count as
    often as they come, since every row is a text. Only ``doc_id`` and ``text`` are read, so other
    columns may have any name. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = count_words(docs, typos)
    ranked = freeze(dense_numbers(words, [F.col("n").desc(), F.col("word")], "id"), "words")
    near = freeze(_neighbours(ranked), "near")
    named = ranked.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    joined = ranked.join(near, "id", "left").join(named, "best", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = freeze(joined.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")).alias("form_id"), F.when(takes, F.col("best_word")).alias("form"),
        F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    last = ranked.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    rooted = roots.join(last, "root").select("id", "root_word")
    return formed.join(rooted, "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
