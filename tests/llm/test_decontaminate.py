import hashlib
import random
import re

from casework.llm.decontaminate import decontaminate

DOCS, ITEMS = "doc_id long, text string, fingerprint int, row string", "item_id long, text string, at int"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, span=10):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(span, len(v))
            if not n:
                continue
            wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    if item is not None:
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    found = decontaminate(
        spark.createDataFrame([(d, t, 1, "r") for d, t in docs], DOCS),
        spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_planted_passages_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: [rng.choice("a b c d é Zz 7 the of and".split()) + str(rng.randrange(40)) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([10, 11, 14, 30])))) for i in range(25)]
    docs = []
    for d in range(120):
        w = some(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            v = items[rng.randrange(25)][1].split()
            low = rng.randrange(len(v))
            at = rng.randrange(len(w) + 1)
            w[at:at] = v[low : low + rng.choice([8, 9, 10, 12, 40])]
        docs.append((d, rng.choice([" ", "\n", "-- "]).join(w).upper() if d % 3 else ", ".join(w)))
    check(spark, docs, items)


def test_short_items_repeats_and_overlaps(spark):
    items = [(1, "one"), (2, "x y"), (3, "X, y!"), (4, ""), (5, None), (6, "a b c d e f g h i j k"), (None, "q r s"),
             (7, "a a a a a a a a a a"), (6, "zz yy xx ww vv uu tt ss rr qq")]
    docs = [(1, "one two x y one x"), (2, "a " * 23), (3, "a b c d e f g h i j k l"), (3, "q r s"), (4, None), (5, ""),
            (None, "x y"), (8, "b c d e f g h i j k"), (8, "b c d e f g h i j k"), (9, "zz yy xx ww vv uu tt ss rr qq")]
    check(spark, docs, items)


def test_empty_tables_and_a_long_text(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b c")], [])
    passage = "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11"
    check(spark, [(1, "w " * 30000 + passage + " v" * 30000)], [(1, passage)])
