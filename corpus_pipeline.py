"""A corpus from raw documents to packed training sequences, stage after stage.

Every stage works on all rows its predecessor kept: documents that the
toxicity and the quality classifier reject go, of exact duplicates and of each
group of near duplicates one document stays, and what is left is packed. All
stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apptflow.llm import exact_dedup, near_dedup, packing, quality, toxicity
from apptflow.llm.common import read, stored
from apptflow.llm.queries import QUALITY_HELD_OUT, TOXIC_HELD_OUT

#: similarity of near duplicates, in percent
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", *TOXIC_HELD_OUT)
    return toxicity.drop_toxic(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(spark, sf_dir, "labels"), "quality", *QUALITY_HELD_OUT)
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("exact_dedup", exact_stage),
          ("near_dedup", near_stage), ("packing", packing_stage)]

#: trained models and tokenizers are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
