import random
import zlib

import numpy as np

from casework.llm.periodic import digest, lyndon_lengths, periodic_runs, plant_periods, runs_of

SCHEMA = "doc_id long, text string, runs string, collapsed int, length string"


def brute(words, least, times):
    """Every maximal stretch for every period; a longer period of the same stretch is none."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def rows(spark, pairs, least, times):
    docs = spark.createDataFrame([(d, t, "r", 1, "l") for d, t in pairs], SCHEMA)
    out = periodic_runs(docs, least, times)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    return sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)


def test_lyndon_lengths_against_definition():
    rng = random.Random(1)
    for _ in range(400):
        parts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 4))]
        symbols = [0]
        for part in parts:
            symbols += [*part, 0]
        found = lyndon_lengths(symbols)
        for i, symbol in enumerate(symbols):
            if symbol:
                end = symbols.index(0, i)
                best = max(j - i for j in range(i + 1, end + 1)
                           if all(symbols[i:j] < symbols[k:j] for k in range(i + 1, j)))
                assert found[i] == best


def test_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words = []
        while len(words) < 60:
            root = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))]
            words += (root * rng.randrange(1, 6))[: rng.randrange(1, 30)]
        found = runs_of(np.array([0, *words, 0]), 2, 2)
        assert [(s - 1, n, q) for s, n, q in found.tolist()] == brute(words, 2, 2)


def test_texts_against_brute_force(spark):
    rng = random.Random(3)
    pairs = []
    for d in range(150):
        words = []
        for _ in range(rng.randrange(5)):
            root = [rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 12))]
            words += (root * rng.randrange(1, 7))[: rng.randrange(1, 90)]
            words += [rng.choice("xyz") for _ in range(rng.randrange(4))]
        pairs.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    for least, times in ((24, 3), (6, 2), (1, 4)):
        expected = []
        for d, text in pairs:
            found = brute(text.split(), least, times)
            expected.append((d, found, collapse(text.split(), found)))
        assert rows(spark, pairs, least, times) == sorted(expected, key=repr)
        assert sum(len(r) for _, r, _ in expected) > 20


def test_edge_cases(spark):
    long = "a b " * 150_000
    pairs = [(1, None), (2, ""), (3, " \n "), (None, "z " * 24), (None, "z " * 24), (4, "z " * 23), (5, long),
             (6, "a\xa0a " * 30), (7, "\x1c " * 30)]
    out = rows(spark, pairs, 24, 3)
    by_id = {d: (r, c) for d, r, c in out}
    assert by_id[1] == by_id[2] == by_id[3] == ([], "")
    assert out.count((None, [(0, 24, 1)], "z")) == 2
    assert by_id[4] == ([], "z " * 22 + "z")
    assert by_id[5] == ([(0, 300_000, 2)], "a b")
    assert by_id[6] == ([(0, 30, 1)], "a\xa0a") and by_id[7] == ([(0, 30, 1)], "\x1c")
    assert rows(spark, [], 24, 3) == []


def test_digest_takes_the_greatest_exponent(spark):
    text = "p q r " * 9 + "end " + "s t " * 13 + "u v " * 13  # 27/3, 26/2, 26/2
    docs = spark.createDataFrame([(1, text, "r", 1, "l"), (2, None, "r", 1, "l")], SCHEMA)
    first, second = sorted(digest(periodic_runs(docs)).collect(), key=lambda r: r.doc_id)
    assert (first.n_runs, first.start, first.length, first.period, first.exponent_milli) == (3, 28, 26, 2, 13000)
    assert second[1:6] == (0, None, None, None, None) and second.runs_sha256 == second.collapsed_sha256


def test_planted_texts(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{i}" for i in range(d % 70)), "r", 1, "l") for d in range(200)], SCHEMA)
    for r in plant_periods(docs).collect():
        words, h = [f"w{i}" for i in range(r.doc_id % 70)], zlib.crc32(b"%d" % r.doc_id)
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert r.text == " ".join(words)
    assert plant_periods(spark.createDataFrame([(None, "a  b", "r", 1, "l")], SCHEMA)).first().text == "a  b"
