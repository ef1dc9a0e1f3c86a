import math
import os
import random
from collections import Counter, defaultdict

import pytest

from casework.llm.quality_lm import _CLASS, ORDER, PEAK, Classifier, classify, collect_model, scores, train

DOCS, LABELS = "doc_id long, text string, lang string, perplexity int, kept string", "doc_id long, quality int, toxic int, run int"


def brute_model(texts):
    """Interpolated modified Kneser-Ney over class tuples, by recursion."""
    padded = [[0] * (ORDER - 1) + [int(_CLASS[b]) for b in t.encode()] for t in texts]
    counts = [None] * (ORDER + 1)
    counts[ORDER] = Counter(tuple(p[i : i + ORDER]) for p in padded for i in range(len(p) - ORDER + 1))
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, total, left = [None], [None], [None]
    for n in range(1, ORDER + 1):
        c = Counter(counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        d = [0] + [min(max(k - (k + 1) * y * c[k + 1] / c[k] if c[k] else k / 2, 0.1), k) for k in (1, 2, 3)]
        off.append(d)
        t, g = Counter(), defaultdict(float)
        for run, m in counts[n].items():
            t[run[:-1]] += m
            g[run[:-1]] += d[min(m, 3)]
        total.append(t), left.append(g)

    def p(run):
        n = len(run)
        if n == 0:
            return 1 / 64
        h = run[:-1]
        if not total[n][h]:
            return p(run[1:])
        m = counts[n][run]
        seen = (m - off[n][min(m, 3)]) / total[n][h] if m else 0
        return seen + left[n][h] / total[n][h] * p(run[1:])

    return p


def brute_scores(p, text):
    s = [0] * (ORDER - 1) + [int(_CLASS[b]) for b in text.encode()]
    bits = [-math.log2(p(tuple(s[i : i + ORDER]))) for i in range(len(s) - ORDER + 1)]
    return 2 ** (sum(bits) / len(bits)), sum(max(b - PEAK, 0) for b in bits) / len(bits)


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS),
            spark.createDataFrame([(*r, 1) for r in labels], LABELS))


def held_out(spark, text):
    from pyspark.sql import functions as F

    from casework.llm.quality_lm import _held_out
    return spark.createDataFrame([(text,)], "text string").select(_held_out()).first()[0]


def test_model_and_scores_against_recursion(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "of", "Übung", "x1", "and,", "été"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    docs, labels = frames(spark, [(i, t, "en") for i, t in enumerate(texts)], [(i, 1, 0) for i in range(30)])
    trained = [t for i, t in enumerate(texts[:30]) if not held_out(spark, t)]
    p = brute_model(trained)
    model = collect_model(train(docs, labels))
    probe = texts + ["", "zzz ### QQQ", "a", "日本"]
    rows = spark.createDataFrame(list(enumerate(probe)), "i int, text string").select("i", scores(model).alias("s")).collect()
    for r in rows:
        if not probe[r.i]:
            assert r.s.perplexity is None and r.s.excess is None
            continue
        perplexity, excess = brute_scores(p, probe[r.i])
        assert r.s.perplexity == pytest.approx(perplexity, rel=1e-3)
        assert r.s.excess == pytest.approx(excess, rel=1e-2, abs=1e-4)
    total = sum(p((5, 6, 7, w)) for w in range(64))
    assert total == pytest.approx(1)


def test_nulls_ties_and_unknown_languages(spark):
    docs = [(i, f"good text number {i} of the lot", "en") for i in range(60)]
    docs += [(100, None, "en"), (101, "", None), (None, "good text", "en"), (102, "### $$$ %%%", "xx"), (103, "### $$$ %%% &&&", "en"),
             (5, docs[5][1], "en"), (104, "x" * 300000, "en")]
    labels = [(i, 1, 0) for i in range(60)] + [(103, 1, 0), (103, 0, 0), (None, 1, 0), (104, None, None)]
    found = classify(*frames(spark, docs, labels)).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert len(found) == len(docs)
    assert kept[100] and kept[101] and kept[102] and not kept[103] and not kept[104]
    assert sum(kept[i] for i in range(60)) >= 57
    d, lab = frames(spark, docs, labels)
    passed = Classifier(d, lab).keep(d)
    assert passed.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in passed.where("doc_id is not null and text is not null").collect()) == sorted(
        (i, t) for i, t, _ in docs if i is not None and t is not None and kept[i])


def test_no_labels_and_empty_tables(spark):
    docs, labels = frames(spark, [(1, "some text", "en")], [])
    assert [(r.doc_id, r.kept) for r in classify(docs, labels).collect()] == [(1, True)]
    docs, labels = frames(spark, [], [])
    assert classify(docs, labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_accuracy_on_documents_without_a_say_in_the_model(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    unseen = labels.where("doc_id % 3 = 0")
    found = classify(docs, labels.where("doc_id % 3 <> 0")).join(unseen, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in found if r.quality == 0]
    assert sum(good) / len(good) >= 0.9
    assert sum(junk) / len(junk) <= 0.2
