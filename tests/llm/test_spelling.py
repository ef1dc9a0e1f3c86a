import random
import re
import zlib
from collections import Counter

from casework.llm.spelling import MIN_COUNT, MIN_LENGTH, spelling_variants

SCHEMA = "doc_id long, text string, id int, word string, n string, key string"


def near(a, b):
    """One insertion, deletion or replacement apart, tried letter by letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, typos=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typos and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= MIN_LENGTH and k >= MIN_COUNT}
    form, links = {}, {}
    for w in n:
        links[w] = [v for v in n if near(w, v)]
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n.get(form[w])))
    return sorted(out)


def found(spark, rows, typos=True):
    docs = spark.createDataFrame([(d, t, 1, "w", "n", "k") for d, t in rows], SCHEMA)
    out = spelling_variants(docs, typos)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abßé") for _ in range(rng.randrange(4, 8))) for _ in range(40)]
    base += ["aaaaaa", "aaaaa", "aaaaaaa", "abaaa", "Étude", "étude", "×÷abc"]
    rows = []
    for d in range(80):
        words = []
        for _ in range(60):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((d if d else None, rng.choice([" ", "-", "1", "’", "Ā"]).join(words)))
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert found(spark, rows, False) == brute(rows, False)
    assert any(r[2] not in (r[0], r[1]) for r in expected)  # a chain of forms


def test_long_words_and_odd_texts(spark):
    long = "".join(chr(97 + i % 26) for i in range(300))
    texts = [long] * 4 + [long[:63], long[:64], long[:65]] * 3 + [long + "x"] * 8
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None), (99, ""), (99, "123 ... 中"), (None, "a b c")]
    assert found(spark, rows, False) == brute(rows, False)
    assert found(spark, rows) == brute(rows)
    same = [(7, "hello world")] * 3 + [(8, "hallo")] * 7
    assert found(spark, same) == brute(same)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "xy")]) == []
