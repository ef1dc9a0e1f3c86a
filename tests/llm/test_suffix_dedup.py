import random
from collections import defaultdict

from casework.llm.suffix_dedup import digest, remove_repeats
from casework.llm.tables import text_key

SCHEMA = "doc_id long, text string, spans int, kept string, anchor string"


def brute(keys, rows, length, keep_first):
    """Every stretch of ``length`` bytes by the places it starts at."""
    distinct = {(d is None, d or 0, keys[t]): (t or "").encode() for d, t in rows}
    places = defaultdict(list)
    for key in sorted(distinct):
        raw = distinct[key]
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((key, i))
    gone = defaultdict(set)
    for found in places.values():
        for key, i in found[1:] if keep_first else found if len(found) > 1 else []:
            gone[key].update(range(i, i + length))
    out = []
    for d, t in rows:
        key = (d is None, d or 0, keys[t])
        raw, off = distinct[key], gone[key]
        edges = [i for i in range(len(raw) + 1) if ((i in off) != (i - 1 in off))]
        out.append((d, bytes(b for i, b in enumerate(raw) if i not in off), list(zip(edges[::2], edges[1::2]))))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "k", "a") for d, t in rows], SCHEMA)


def check(spark, rows, length, gram, group=512):
    docs = frame(spark, rows)
    keys = {r.text: r.text_key for r in docs.select("text", text_key()).collect()}
    for keep_first in (True, False):
        out = remove_repeats(docs, length, keep_first, gram, group)
        assert out.columns == ["doc_id", "kept", "spans"]
        found = sorted(((r.doc_id, bytes(r.kept), [tuple(s) for s in r.spans]) for r in out.collect()), key=repr)
        assert found == brute(keys, rows, length, keep_first)
    return found


def texts(seed, n, alphabet="abé"):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    out = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], p * 2]))
            parts.append("".join(rng.choice("xyzè") for _ in range(rng.randrange(6))))
        out.append((d, "".join(parts)))
    return out


def test_against_brute_force(spark):
    rows = texts(1, 60)
    check(spark, rows, 20, 6)
    check(spark, rows, 13, 13)
    check(spark, rows, 9, 1)


def test_hot_anchors_are_split(spark):
    rows = texts(2, 60)
    check(spark, rows, 20, 6, group=1)
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=50))
    rows = [(d, "".join(rng.choice("pqrs") for _ in range(30)) + passage + "".join(rng.choice("tuvw") for _ in range(30)))
            for d in range(120)]
    assert all(sum(b - a for a, b in spans) >= 50 for _, _, spans in check(spark, rows, 30, 8, group=20))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 500), (4, "a" * 500), (5, "ab" * 300), (None, "ab" * 300),
            (None, "ab" * 300), (6, "ab" * 99 + "a"), (7, "x" + "ab" * 100), (8, "né" * 150), (9, "é" * 99 + "e")]
    found = check(spark, rows, 200, 64)
    assert (4, b"", [(0, 500)]) in found  # it repeats itself
    assert check(spark, [(1, "unlike" * 20), (1, "unlike" * 20)], 100, 32) == [
        (1, b"", [(0, 120)]), (1, b"", [(0, 120)])]
    once = "".join(random.Random(9).choices("abcdefghij", k=300))
    assert check(spark, [(1, once)] * 30, 100, 32) == [(1, once.encode(), [])] * 30  # one document, many rows
    assert check(spark, [], 200, 64) == [] and check(spark, [(None, None)], 200, 64) == [(None, b"", [])]


def test_long_text_and_digest(spark):
    rng = random.Random(7)
    once = "".join(rng.choice("abcdefghij ") for _ in range(2_500_000))
    docs = frame(spark, [(1, once), (2, "z" * 100 + once[1_000_000:1_000_300] + "y" * 100), (3, None)])
    out = sorted(tuple(r)[:4] for r in digest(remove_repeats(docs, keep_first=False)).collect())
    assert out == [(1, 2_500_000, 300, 1), (2, 500, 300, 1), (3, 0, 0, 0)]
    out = sorted(tuple(r)[:4] for r in digest(remove_repeats(docs)).collect())
    assert out == [(1, 2_500_000, 0, 0), (2, 500, 300, 1), (3, 0, 0, 0)]
