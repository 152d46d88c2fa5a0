"""The registered queries of this subpackage, one per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import conversations, decontaminate, htmltext, interactions, language, lmscore, mixing, neardup, quality, secrets, substring, tokencount, urlfilter
from tallyforge.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op2(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op4(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train(urlfilter.samples(spark)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op11(table(spark, sf_dir, "conversations"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.op12(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_near_duplicates, op3_benchmark_decontamination, op4_language_id, op5_html_extraction, op6_substring_dedup, op7_secret_scans, op8_mixing, op9_url_filters, op10_quality_rules,
        op11_conversation_repair, op12_lm_scoring, op13_filter_interactions,
    )
    return {f.__name__: f for f in found}
