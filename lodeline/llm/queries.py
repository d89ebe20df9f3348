"""Queries of the training-data operators over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm import chat, decontaminate, html_extract, licenses, mixing, near_dup, quality_model, quality_rules, token_counts, url_filter
from lodeline.llm.oracles import CHAT_SQL, NEAR_DUP_SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return rows.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {token_counts.LIMIT} AS over_limit", "cut_chars")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate(table(spark, sf_dir, "conversations"))
    return rows.selectExpr("conv_id", "perspective", "part", "n_turns", "text", "transform(masks, m -> concat_ws('-', m.start, m.end)) AS masks", "n_masked")


def queries() -> dict[str, Query]:
    found = (
        op1_quality_rules, op2_url_filter, op3_html_extract, op4_near_dup, op5_quality_model,
        op6_token_counts, op7_mixing, op8_licenses, op9_decontaminate, op10_chat,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dup": NEAR_DUP_SQL, "op10_chat": CHAT_SQL}
