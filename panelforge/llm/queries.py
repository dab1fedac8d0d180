"""The named queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import bpe, chunking, edits, lines, merkle, packing, pii, quality, simhash, spelling, substrings, toxicity, urls
from panelforge.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), RANKS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.revised_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_figures(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.span_digests(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii": op2_pii,
        "op3_bpe": op3_bpe,
        "op4_lines": op4_lines,
        "op5_simhash": op5_simhash,
        "op6_chunking": op6_chunking,
        "op7_packing": op7_packing,
        "op8_quality": op8_quality,
        "op9_token_counts": op9_token_counts,
        "op10_url_filter": op10_url_filter,
        "op11_merkle": op11_merkle,
        "op12_substrings": op12_substrings,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality": quality.ORACLE,
        "op10_url_filter": urls.ORACLE,
        "op11_merkle": merkle.ORACLE,
        "op12_substrings": substrings.ORACLE,
        "op13_spelling": spelling.ORACLE,
    }
