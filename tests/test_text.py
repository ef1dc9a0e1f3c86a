import random

import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from casework.functions import text

SPACES = text.SPACES


def trim(s):
    return s.strip(SPACES)


def clean(s):
    lines = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(t for t in map(trim, lines) if t)


def pack(s, limit):
    """The greedy rule line by line, in bytes."""
    out, current = [], ""
    for line in clean(s).split("\n"):
        if not line:
            continue
        if current and len(current.encode()) + 1 + len(line.encode()) > limit:
            out.append(current)
            current = ""
        current = f"{current}\n{line}" if current else line
    return out + [current] if current else out


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


CASES = [
    "", "   ", "a", " a \r\n\r\n b\rc ", " x \n　", "é" * 700 + "\n" + "b" * 500,
    "x" * 3000 + "\ny\nz", "a" * 1200 + "\nb", "a" * 1198 + "\nb\nc", "a" * 1199 + "\nb",
    "tab\tinside  stays", "\x0b\x0c lead", "日本語\n" * 300, "one\x85two", "​zero width stays",
    "end  ", "\n\n\n", "🙂" * 299 + "\n" + "🙂\n🙂",
]


def test_trim_and_blank_to_null(spark):
    assert column(spark, CASES, text.trim_space) == [trim(c) for c in CASES]
    assert column(spark, CASES, text.nullable_string) == [trim(c) or None for c in CASES]


def test_document_text_is_clean_and_idempotent(spark):
    once = column(spark, CASES, text.normalize_document_text)
    assert once == [clean(c) for c in CASES]
    assert column(spark, once, text.normalize_document_text) == once


def test_match_text_collapses_unicode_space(spark):
    found = column(spark, ["  A  B\r\n C ", "", "x"], text.normalize_match_text)
    assert found == ["a b c", "", "x"]
    assert column(spark, found, text.normalize_match_text) == found


@pytest.mark.parametrize("limit", [1, 5, 600, 1200])
def test_packing_equals_the_fold(spark, limit):
    rng = random.Random(limit)
    made = ["\n".join("é🙂ab "[rng.randrange(5)] * rng.randrange(1, 400) for _ in range(rng.randrange(30)))
            for _ in range(60)]
    values = CASES + made
    assert column(spark, values, lambda c: text.pack_paragraphs(c, limit)) == [pack(v, limit) for v in values]


def test_packing_joins_back_to_the_text(spark):
    found = column(spark, CASES, text.pack_paragraphs)
    assert ["\n".join(p) for p in found] == [clean(c) for c in CASES]


@hyp(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r\t é "), min_size=1, max_size=30), st.integers(1, 12))
def test_packing_property(spark, values, limit):
    assert column(spark, values, lambda c: text.pack_paragraphs(c, limit)) == [pack(v, limit) for v in values]


def test_packing_needs_a_positive_limit():
    with pytest.raises(ValueError):
        text.pack_paragraphs(None, 0)


def test_long_documents_pack_in_linear_time(spark):
    lines = 200_000
    df = spark.range(1).select(F.repeat(F.lit("word here\n"), lines).alias("text"), F.lit(1).alias("document_id"))
    chunks = text.chunk_documents(df)
    assert chunks.agg(F.max("chunk_index"), F.sum(F.octet_length("content"))).first()[0] == lines // 120


def test_empty_document_has_no_chunks(spark):
    df = spark.createDataFrame([(1, " \n "), (2, "x")], "document_id long, text string")
    assert rows_of(text.chunk_documents(df)) == [(2, 0, "x")]


def test_equal_fold(spark):
    df = spark.createDataFrame([("POSSIBLE api key EXPOSURE",), ("Poſſible API Key expoſure",), ("Possible",), (None,)], "s string")
    assert [r[0] for r in df.select(text.equal_fold(F.col("s"), "Possible API key exposure")).collect()] == [True, True, False, None]
