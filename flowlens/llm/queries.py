"""The registered training-data queries: name to (builder, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, chat, exact_dedup, html_extract, lexical_search, line_dedup, mixing, packing, periodic_runs, quality, simhash, sql,
               toxicity, url_filter)
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"), html_extract.trained())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = chat.as_chains(turns.unionByName(chat.control_conversation(spark)))
    return chat.digests(chat.conversations_of(messages))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


Q = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_line_dedup": (op2_line_dedup, None),
    "op3_html_extraction": (op3_html_extraction, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_chat_formatting": (op5_chat_formatting, sql.CHAT),
    "op6_exact_dedup": (op6_exact_dedup, sql.EXACT),
    "op7_mixing": (op7_mixing, None),
    "op8_url_filters": (op8_url_filters, sql.URLS),
    "op9_simhash": (op9_simhash, None),
    "op10_quality_rules": (op10_quality_rules, sql.QUALITY),
    "op11_lexical_search": (op11_lexical_search, sql.SEARCH),
    "op12_bpe": (op12_bpe, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
