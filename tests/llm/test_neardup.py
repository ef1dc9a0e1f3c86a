import random
import re
from collections import Counter

import pytest

from casework.llm.components import components
from casework.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, kept string, bucket int"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent):
    """Every pair compared, one after the other."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    ids = sorted({d for d, s in sets if d is not None})
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    out = []
    for d, s in sets:
        out.append((d, len(s), None if d is None else find(d), d is None or find(d) == d))
    return sorted(out, key=repr)


def check(spark, rows, percent=85):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    found = near_duplicates(docs, percent=percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, percent)


def mutated(words, share, rng):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def test_random_texts_and_copies_against_every_pair(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 9, 20, 60, 200, 400]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.05):
            rows.append((n, " ".join(mutated(base, share, rng))))
            n += 1
    check(spark, rows)
    check(spark, rows, 80)


def test_large_group_whose_members_differ_from_each_other(spark):
    rng = random.Random(7)
    base = [rng.choice(VOCABULARY) for _ in range(300)]
    rows = [(i, " ".join(mutated(base, 0.008, rng))) for i in range(150)]
    check(spark, rows)


def test_few_links_in_a_large_bucket_of_texts_near_the_threshold(spark):
    """All share their buckets, hardly any two are linked: every pair has to be met."""
    rng = random.Random(3)
    base = [rng.choice(VOCABULARY) for _ in range(200)]
    rows = []
    for i in range(1500):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"own{i}"
        rows.append((i, " ".join(words)))
    groups = brute_by_counts(rows, 85)
    assert 3 <= sum(i != g for i, g in groups.items()) <= 150
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, percent=85).collect()}
    assert found == groups


def brute_by_counts(rows, percent):
    """The component of each text, all pairs compared through an index of shingles."""
    sets, index, group = {d: shingles(t) for d, t in rows}, {}, {d: d for d, _ in rows}
    for d, s in sets.items():
        common = Counter(x for g in s for x in index.get(g, ()))
        for x, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[x]) - n) and group[x] != group[d]:
                low, high = sorted((group[x], group[d]))
                group = {k: low if v == high else v for k, v in group.items()}
        for g in s:
            index.setdefault(g, []).append(d)
    return group


def test_nulls_empty_long_repeated_and_case(spark):
    long = " ".join(VOCABULARY * 20)
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, "One two"), (5, "one\ttwo"), (5, "one\ttwo"),
            (6, "one two three"), (7, long), (8, long + " end"), (None, "one two"), (None, None),
            (9, "É é x"), (10, "É É x"), (11, "É é X")]
    check(spark, rows)


def test_rows_that_share_an_id_are_one_node(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "p q r s t u v"), (3, "p q r s t u v")]
    check(spark, rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("edges, expected", [
    ([(1, 2), (2, 3), (5, 4), (6, 5)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([], {}),
])
def test_components(spark, edges, expected):
    links = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == expected


def test_a_cell_of_many_short_sets_stays_small():
    import tracemalloc

    import pyarrow as pa

    from casework.llm.neardup import _compare

    n = 24000  # sets of two items, each item in two sets
    cell = pa.table({
        "low": pa.array([0] * n), "high": pa.array([1] * n), "own": pa.array([i % 2 for i in range(n)]),
        "node": pa.array(range(n)), "component": pa.array(range(n)),
        "items": pa.array([[i // 2 * 2, i // 2 * 2 + 1] for i in range(n)], pa.list_(pa.int64()))})
    tracemalloc.start()
    found = _compare(80)(cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [(i, i + 1) for i in range(0, n, 2)]
    assert peak < 400e6
