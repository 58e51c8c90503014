"""The registered queries of this package: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import alignment, decontaminate, html_wrappers, importance, near_dedup, preferences, quality_rules, secret_scan, sentence_pieces, source_mix, substring_dedup, suffix_dedup, token_files
from corpusmill.llm.common import table
from corpusmill.session import work_folder


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preferences.formatted(*preferences.alternative_endings(table(spark, sf_dir, "conversations")))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",") for c in ("chosen_spans", "rejected_spans")}
    return found.withColumns(spans)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), like=near_dedup.Likeness(shingle=3, percent=85))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.report(table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder).withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = alignment.Pair(*map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")))
    return alignment.report(table(spark, sf_dir, "documents"), pair)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.report(table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (op1_preference_formatting, op2_minhash_near_dedup, op3_substring_dedup, op4_html_wrappers, op5_suffix_array_dedup, op6_token_id_files, op7_quality_rules, op8_sentencepiece, op9_benchmark_decontamination, op10_secret_scans, op11_importance_resampling, op12_cross_tokenizer_alignment, op13_source_mix)}
