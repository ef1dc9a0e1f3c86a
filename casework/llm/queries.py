"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casework.llm import packing, periodic, pii, suffix_dedup, token_files
from casework.llm.decontaminate import decontaminate
from casework.llm.html_text import extract
from casework.llm.licenses import scan_licenses
from casework.llm.linededup import dedupe_lines
from casework.llm.neardup import near_duplicates
from casework.llm.oracles import ORACLES
from casework.llm.quality_lm import classify
from casework.llm.quality_rules import apply_host_rules
from casework.llm.spelling import spelling_variants
from casework.llm.tables import given
from casework.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(given(spark, sf_dir, "documents"), percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(given(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(given(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.digest(packing.pack(given(spark, sf_dir, "documents"), path, end_id=0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_host_rules(given(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(given(spark, sf_dir, "pages"))


def op8_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(given(spark, sf_dir, "documents")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tokenizer = fresh_path(spark, "corpus"), public_tokenizers.path("word_bpe_49k.json")
    token_files.write_corpus(given(spark, sf_dir, "documents"), path, tokenizer, end_id=1)
    return token_files.digest(token_files.read_corpus(spark, path))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.plant_periods(given(spark, sf_dir, "documents"))
    return periodic.digest(periodic.periodic_runs(docs))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs, keep_first=False))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(given(spark, sf_dir, "documents"), typos=True)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_neardup,
        op2_line_dedup,
        op3_license_scan,
        op4_packing,
        op5_quality_rules,
        op6_decontaminate,
        op7_html_text,
        op8_quality_lm,
        op9_pii,
        op10_token_files,
        op11_periodic_runs,
        op12_suffix_dedup,
        op13_spelling_variants,
    )
}

__all__ = ["ORACLES", "QUERIES"]
