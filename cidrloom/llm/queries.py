"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, lm, mixing, neardup, planes, substrings, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_linededup": op2_linededup,
    "op3_planes": op3_planes,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_lm": op6_lm,
    "op7_substrings": op7_substrings,
    "op8_decontam": op8_decontam,
    "op9_neardup": op9_neardup,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op2_linededup": linededup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_topk": topk.ORACLE,
    "op7_substrings": substrings.ORACLE,
    "op8_decontam": decontam.ORACLE,
    "op9_neardup": neardup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
