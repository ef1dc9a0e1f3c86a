"""The pipeline against brute force versions of its stages, one stage's output at a time."""

import os

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from casework.workspace import freeze
from tests.llm import test_decontaminate, test_linededup, test_neardup, test_quality_lm
from casework.llm.quality_lm import EXCESS_QUANTILE, MARGIN, PERPLEXITY_QUANTILE

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_quality(spark, docs, labels):
    import math
    trust = {}
    for d, q, t in labels:
        trust[d] = trust.get(d, True) and q == 1 and t == 0
    good = [r for r in docs if trust.get(r[0])]
    held = [test_quality_lm.held_out(spark, r[1]) for r in good]
    p = test_quality_lm.brute_model([r[1] for r, h in zip(good, held) if not h])
    memo = {}

    def score(text):
        if text not in memo:
            memo[text] = test_quality_lm.brute_scores(p, text)
        return memo[text]

    limits = {}
    for lang in {r[2] for r in docs}:
        sample = [score(r[1]) for r, h in zip(good, held) if h and r[2] == lang and r[1]]
        if sample:
            limits[lang] = []
            for i, q in ((0, PERPLEXITY_QUANTILE), (1, EXCESS_QUANTILE)):
                v = sorted(s[i] for s in sample)
                mean = sum(v) / len(v)
                sd = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v))
                limits[lang].append(v[max(0, math.ceil(q * len(v)) - 1)] + MARGIN * sd / math.sqrt(len(v)))
    out = []
    for r in docs:
        s = score(r[1]) if r[1] else (0, 0)
        near = r[2] in limits and any(abs(a - b) < 1e-3 * (abs(b) + 1e-3) for a, b in zip(s, limits[r[2]]))
        out.append((r, r[2] not in limits or all(a <= b for a, b in zip(s, limits[r[2]])), near))
    return out


def test_every_stage_on_what_the_last_one_kept(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = freeze(stages["quality"](spark, documents, SF_DIR), "stage")
    assert kept.columns == documents.columns
    found = set(rows(kept))
    for row, verdict, near in brute_quality(spark, [tuple(r) for r in documents.collect()], labels):
        assert near or (row in found) == verdict
    assert 0 < len(found) < documents.count()

    lines = freeze(stages["line_dedup"](spark, kept, SF_DIR), "stage")
    expected = test_linededup.brute([(r.doc_id, r.text) for r in kept.collect()], 50)
    assert rows(lines.select("doc_id", "text")) == sorted([(d, t) for d, t, _ in expected], key=repr)
    assert lines.where("n_chars <> length(text)").count() == 0 and lines.columns == documents.columns

    single = freeze(stages["near_dedup"](spark, lines, SF_DIR), "stage")
    groups = test_neardup.brute([(r.doc_id, r.text) for r in lines.collect()], 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, _, keep in groups if keep)

    clean = freeze(stages["benchmark_free"](spark, single, SF_DIR), "stage")
    judged = test_decontaminate.brute([(r.doc_id, r.text) for r in single.collect()], benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in judged if not r[-1])

    packed = stages["pack"](spark, clean, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_repeated_and_nameless_rows(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", None, None, None), (2, "z", "en", "s", 1),
         (None, "a b c d e f", "en", "s", 11), (3, None, "en", "s", None), (4, "", "", "", 0)], schema)
    stages = dict(corpus_pipeline.STAGES)
    single = stages["near_dedup"](spark, docs, SF_DIR)
    assert rows(single.select("doc_id", "text")) == sorted(
        [(1, "a b c d e f"), (2, "z"), (3, None), (4, ""), (None, "a b c d e f")], key=repr)
    for name in ("quality", "line_dedup", "benchmark_free"):
        assert stages[name](spark, docs, SF_DIR).columns == docs.columns
        assert stages[name](spark, docs.limit(0), SF_DIR).count() == 0
    assert stages["benchmark_free"](spark, docs, SF_DIR).count() == 7
    assert stages["pack"](spark, docs, SF_DIR).count() == 7


def test_unrelated_texts_of_one_id_both_stay(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(7, t, "en", "s", len(t)) for t in (one, other, other + " end", other)], schema)
    texts = [r.text for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()]
    assert len(texts) == 2 and one in texts and (other in texts or other + " end" in texts)


def test_a_clean_text_stays_when_its_id_repeats_a_copy(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((1, one), (7, one), (7, other), (8, other))], schema)
    found = rows(corpus_pipeline.near_dedup(spark, docs, SF_DIR).select("doc_id", "text"))
    assert (1, one) in found and len(found) == 2 and found[1][1] == other


def test_columns_with_clashing_names(spark):
    names = ["row", "key", "node", "gone", "again", "hit", "n_deleted", "text_key", "first", "other", "runs", "kept"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    docs = freeze(docs.select("*", *[F.col("source").alias(n) for n in names]), "named")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.pack(spark, docs, SF_DIR).count() > 0


def test_run_goes_through(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
