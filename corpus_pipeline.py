"""From raw documents to packed training sequences, in five stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartline.llm import balance, packing, pii, quality, simhash_near
from chartline.llm.common import importable, stored, tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on weak labels rejects go."""
    importable(spark)
    return quality.accepted(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the one with the smallest
    doc_id. SimHash tiles find the candidates, whole shingle sets confirm them."""
    importable(spark)
    return simhash_near.deduplicated(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources' words come to their targets."""
    importable(spark)
    return balance.remix(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of neighbouring documents packed into sequences; one row per piece."""
    importable(spark)
    return packing.packed(docs)


STAGES = [("quality_classifier", quality_classifier), ("simhash_dedup", simhash_dedup), ("pii_masking", pii_masking), ("source_mixing", source_mixing),
          ("curve_packing", curve_packing)]

# Learned scores, fingerprints and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
