import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from casework.llm.quality_lm import Classifier
from casework.llm.word_lm import train_words, word_perplexity
from casework.workspace import brief_shuffles


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+|[^0-9a-z\u0080-\U0010ffff\s]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over tuples of words, by recursion."""
    padded = [["<s>"] * (order - 1) + words_of(t) + ["</s>"] for t in texts if words_of(t)]
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple(p[i : i + order]) for p in padded for i in range(len(p) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, total, left = [None], [None], [None]
    for n in range(1, order + 1):
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
            return 1 / (len(counts[1]) + 1)
        h = run[:-1]
        if not total[n][h]:
            return p(run[1:])
        m = counts[n][run]
        return (m - off[n][min(m, 3)] if m else 0) / total[n][h] + left[n][h] / total[n][h] * p(run[1:])

    return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity_against_recursion(spark, order):
    rng = random.Random(order)
    some = ["the", "The", "of", "Übung", "x1", "and,", "été", "--", "no.one", "\n"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["", None, " \t", "of"]
    p = brute_model([t for t in texts if t], order)
    model = train_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order)
    probe = texts + ["zzz the ### of QQQ", "the of the of never seen", "a", "of the", "日本 of"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(probe)] + [(0, probe[0])], "row long, text string")
    found = {r.row: r.perplexity for r in word_perplexity(model, rows.repartition(4)).collect()}
    for limits in ({"hot": 0}, {"hot": 20, "most_bits": 6}):  # all runs joined; a filter that is too small
        again = {r.row: r.perplexity for r in word_perplexity(model, rows, **limits).collect()}
        assert again == pytest.approx(found, rel=1e-9)
    assert set(found) == {i for i, t in enumerate(probe) if words_of(t or "")}
    for i, perplexity in found.items():
        w = ["<s>"] * (order - 1) + words_of(probe[i]) + ["</s>"]
        bits = [-math.log2(p(tuple(w[j : j + order]))) for j in range(len(w) - order + 1)]
        assert perplexity == pytest.approx(2 ** (sum(bits) / len(bits)), rel=1e-6)


def test_model_of_nothing(spark):
    model = train_words(spark.createDataFrame([(None,), ("",)], "text string"))
    rows = spark.createDataFrame([(1, "a b"), (2, "")], "row long, text string")
    assert [(r.row, r.perplexity) for r in word_perplexity(model, rows).collect()] == [(1, 2.0)]


def test_known_words_in_an_order_never_seen(spark):
    """Shuffled words are spelled as good ones are; only counts of words tell them apart."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(300)]
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def walk():
        out = [rng.choice(vocabulary)]
        for _ in range(60):
            out.append(rng.choice(after[out[-1]]))
        return out

    docs = [(i, " ".join(walk()), "en") for i in range(300)]
    docs += [(1000 + i, " ".join(rng.sample(walk(), 61)), "en") for i in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    judge = Classifier(docs, labels)
    kept = {r.doc_id: r.kept for r in judge.verdicts().collect()}
    assert sum(kept[i] for i in range(240, 300)) >= 57 and not any(kept[i] for i in range(1000, 1030))
    assert {r.doc_id for r in judge.keep(docs).collect()} == {i for i, k in kept.items() if k}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_the_model_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    part, whole = (train_words(d).values.count() for d in (docs.where("doc_id % 4 = 0"), docs))
    assert whole > 2 * part


@pytest.mark.parametrize("order", [2, 3])
def test_many_shards_and_rare_words_give_the_same(spark, order, monkeypatch):
    rng = random.Random(order)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["w1 w2 never seen"])], "row long, text string").repartition(5)
    trained = spark.createDataFrame([(t,) for t in texts[:80]], "text string").repartition(3)
    one = train_words(trained, order)
    expected = {r.row: r.perplexity for r in word_perplexity(one, rows).collect()}
    values = {r.run: r.value for r in one.values.collect()}
    for hot in (0, 20):  # words, parts and runs that have their values in the tasks that need them
        model = train_words(trained, order, hot=hot, a_shard=100)
        assert model.parts.count() > 10 and sorted(r.value for r in model.values.collect()) == pytest.approx(sorted(values.values()))
        found = {r.row: r.perplexity for r in word_perplexity(model, rows, hot=hot, most_bits=10).collect()}
        assert found == pytest.approx(expected, rel=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_room_that_a_run_takes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    values = train_words(docs).values
    size = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in values.inputFiles())
    assert size < 12 * values.count()


def test_brief_shuffles_puts_the_setting_back(spark, settings):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for before in ("false", "true"):
        settings(**{name.replace(".", "__"): before})
        with pytest.raises(ValueError), brief_shuffles(spark):
            assert spark.conf.get(name) == "true"
            raise ValueError
        assert spark.conf.get(name) == before
