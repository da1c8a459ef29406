"""One thin query per training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import chat, decontaminate, html_labels, license_scan, line_dedup, lm_score, packing, pairwise_quality, prefix_trie, quality_rules, simhash, suffix_dedup, whitening

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@register("op1_quality_rules", quality_rules.oracle())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules_query(table(spark, sf_dir, "documents"))


@register("op7_decontaminate", decontaminate.ORACLE)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_line_dedup", line_dedup.ORACLE)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_query(table(spark, sf_dir, "documents"))


@register("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_query(table(spark, sf_dir, "documents"))


@register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op8_chat_rotation", chat.ORACLE)
def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@register("op3_pairwise_quality")
def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_lm_score", lm_score.ORACLE)
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_html_labels")
def op5_html_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labels.html_query(table(spark, sf_dir, "pages"))


@register("op13_license_scan", license_scan.oracle())
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_prefix_trie", prefix_trie.ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
