"""A training corpus from ``documents``: filter, deduplicate, decontaminate, mix, encode.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables. It reads the columns of ``documents`` and drops others, and
returns those columns, the last stage excepted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cidrloom.llm import decontam, mixing, neardup, planes, toxicity
from cidrloom.llm.workspace import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.5
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under ``TOXIC_FROM``.

    Null and empty texts have the score of a text without terms; repeated rows
    share theirs; without labels none is dropped unless the bias says so.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(toxicity.score_toxicity(docs, model).filter(f"tox_score < {TOXIC_FROM}"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Null and empty texts and rows without an id are in no group and stay; all
    rows of a kept id stay.
    """
    return _documents(neardup.drop_near_duplicates(docs, k=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts and items match nothing."""
    return _documents(decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their sizes, in a shuffled order; a doc_id may repeat.

    A null source is a source; rows of one id, and rows without one, draw the
    same count if their sources are equal.
    """
    return _documents(mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids on disk, in the order of the mix: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text is its end id alone; copies are encoded each for itself.
    """
    return planes.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ordered=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_ids", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
