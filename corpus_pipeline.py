"""Training-data pipeline over documents: language ID, quality rules, SimHash near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Defined results: an empty table passes through all stages; null and empty texts, and texts without a letter, go with the
first stage; equal rows are one document after the third; rows without a doc_id are documents like others and give way to
copies that have one. The first stage writes its language over the label, so the second judges by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import language, packing, quality, shared, simhash

#: Least probability of the predicted language. A guess among four languages has 0.25 on average.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is clear stay; lang becomes the predicted one."""
    net = language.learn(docs)
    got = language.predict(docs, net, keep=tuple(docs.columns))
    clear = got.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return clear.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are near their language's reference stay."""
    return quality.keep_good(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.query(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", pack)]

#: Training, union-find and tokenization are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.save(docs, name)
    return docs
