import random

import pytest

from casework.llm.licenses import MIN_COVERAGE, NOTICES, align, scan_licenses

SCHEMA = "doc_id long, text string, license string, coverage int"


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_is_a_common_subsequence_and_nearly_the_longest():
    rng, found, best = random.Random(1), 0, 0
    for _ in range(300):
        b = [rng.randrange(40) for _ in range(rng.randrange(1, 40))]
        a = [x for x in b if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            a.insert(rng.randrange(len(a) + 1), rng.randrange(40))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        found, best = found + len(pairs), best + common(a, b)
    assert found >= 0.9 * best
    assert align(list("abcd"), list("abcd")) == [(i, i) for i in range(4)]
    assert align([], [1]) == [] and align([1, 1], [1]) in ([(0, 0)], [(1, 0)])


def find(spark, texts):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], SCHEMA)
    out = scan_licenses(docs)
    assert out.columns == ["doc_id", "license", "coverage", "first_word", "last_word"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(NOTICES))
def test_every_notice_is_found_whole(spark, name):
    n = len("".join(c if c.isalnum() else " " for c in NOTICES[name]).split())
    found = find(spark, [(1, "three words before " + NOTICES[name].upper() + " after it")])
    assert found == [(1, name, 1.0, 3, n + 2)]


def test_changed_repeated_and_absent_notices(spark):
    words = NOTICES["MIT-text"].split()
    rng = random.Random(3)
    damaged = [w for w in words if rng.random() > 0.08]
    halved = words[: len(words) // 2]
    mit, gpl = NOTICES["MIT"], NOTICES["GPL-3.0"]
    texts = [(1, " ".join(damaged)), (2, " ".join(halved)), (3, f"{mit} {mit}\n{mit} x {gpl}"), (4, None), (5, ""), (None, mit),
             (6, "released under the " * 50), (7, mit), (7, mit), (8, ("word " * 100000) + mit), (9, f"{mit}\n" * 2000)]
    found = find(spark, texts)
    per = {}
    for d, name, *rest in found:
        per.setdefault(d, []).append((name, *rest))
    assert [x[0] for x in per[1]] == ["MIT-text"] and MIN_COVERAGE <= per[1][0][1] < 1
    assert 2 not in per and 4 not in per and 5 not in per and 6 not in per
    assert sorted(x[0] for x in per[3]) == ["GPL-3.0", "MIT", "MIT", "MIT"]
    assert [x[0] for x in per[None]] == ["MIT"] and len(per[7]) == 2
    assert per[8] == [("MIT", 1.0, 100000, 100004)]
    assert len(per[9]) == 2000
    assert find(spark, []) == []


def between(words, every, extra="rem"):
    return " ".join(w + f" {extra}" * (i % every == every - 1) for i, w in enumerate(words))


def test_notices_without_three_words_in_a_row(spark):
    clean = {n: "".join(c if c.isalnum() else " " for c in t).split() for n, t in NOTICES.items()}
    texts = [(1, "Released under MIT License."), (2, "x Released under an MIT License. y"), (3, between(clean["MIT-text"], 2)),
             (4, between(clean["ISC"], 1)), (5, between(clean["BSD"], 3, "line 12 rem")), (6, "Released under MIT License. " * 3),
             (7, "released a b c d e f under a b c d e f the a b c d e f mit a b c d e f license")]
    found = find(spark, texts)
    n = {name: len(words) for name, words in clean.items()}
    assert found == sorted([
        (1, "MIT", 0.8, 0, 3), (2, "MIT", 0.8, 1, 5), (3, "MIT-text", 1.0, 0, n["MIT-text"] + (n["MIT-text"] - 1) // 2 - 1),
        (4, "ISC", 1.0, 0, 2 * n["ISC"] - 2), (5, "BSD", 1.0, 0, n["BSD"] + (n["BSD"] - 1) // 3 * 3 - 1),
        (6, "MIT", 0.8, 0, 3), (6, "MIT", 0.8, 4, 7), (6, "MIT", 0.8, 8, 11)], key=repr)


def test_random_texts_have_none(spark):
    rng = random.Random(5)
    pool = [w for t in NOTICES.values() for w in t.split()]
    assert find(spark, [(i, " ".join(rng.choice(pool) for _ in range(300))) for i in range(50)]) == []
