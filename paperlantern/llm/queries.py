"""The registered queries of the operators here, on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlantern.llm import ann, decontaminate, html_text, jaccard_join, language, line_templates, mixing, quality, resampling, sharding, toxicity, urls, whitening
from paperlantern.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.language(table(spark, sf, "documents"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_templates.drop_lines(table(spark, sf, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.every_fiftieth(table(spark, sf, "embeddings"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf, "pages"))


def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.importance_ranks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_language_id, op3_toxicity, op4_quality, op5_line_dedup, op6_nearest_neighbours,
        op7_decontamination, op8_mixing, op9_url_filter, op10_html_extraction,
        op11_whitening, op12_resampling, op13_sharding,
    )
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.SQL, "op7_decontamination": decontaminate.SQL, "op8_mixing": mixing.SQL, "op9_url_filter": urls.SQL,
    "op12_resampling": resampling.SQL,
}
