"""Summaries, constraint checks and age-based retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import extraction_status

STATUSES = ("added", "discarded", "replaced", "failed")


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def ingestion_report(outcomes: DataFrame) -> DataFrame:
    """One row: how many sources ended in each status."""
    return outcomes.agg(*[_n(F.col("status") == s).alias(s) for s in STATUSES])


def extraction_summary(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Per document: pages, and pages that are empty or sparse."""
    p = pages.withColumn("s", extraction_status(text_col))
    return p.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), _n(F.col("s") == "empty").alias("empty_pages"), _n(F.col("s") == "sparse").alias("sparse_pages"))


def sentence_summary(sentences: DataFrame, pages: DataFrame | None = None, least_words: int = 4) -> DataFrame:
    """One row over all sentences; with pages (page and word counts) also how many there are, and how many have no words."""
    own = sentences.agg(F.count(F.lit(1)).alias("sentences"), F.count_distinct("document_id").alias("documents"), _n(F.col("source_word_count") < least_words).alias("short_sentences"))
    if pages is None:
        return own
    return own.crossJoin(pages.agg(F.count(F.lit(1)).alias("pages"), _n(F.coalesce("word_count", F.lit(0)) == 0).alias("pages_without_words")))  # one row each


def passage_summary(passages: DataFrame, max_words: int) -> DataFrame:
    """One row over all passages: counts, blocks that were split, mean words (0 without passages)."""
    per = passages.groupBy("document_id", "page_index", "logical_block_index").agg(F.count(F.lit(1)).alias("p"), _n(F.col("retrieval_eligible")).alias("e"), _n(~F.col("retrieval_eligible")).alias("s"), _n(F.col("word_count") > max_words).alias("o"), F.sum("word_count").alias("w"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = F.round(F.coalesce(F.sum("w") / F.sum("p"), F.lit(0.0)), 6)
    return per.agg(total("p").alias("passages"), total("e").alias("eligible"), total("s").alias("short"), total("o").alias("over_long"), mean.alias("mean_words"), F.count(F.lit(1)).alias("blocks"), _n(F.col("p") > 1).alias("split_blocks"))


def content_types(passages: DataFrame) -> DataFrame:
    return passages.agg(F.array_sort(F.collect_set("content_type")).alias("content_types"))


def block_numbers(boxes: DataFrame, passage_sentences: DataFrame) -> DataFrame:
    """passage, the distinct physical blocks under its sentences' boxes, sorted."""
    under = passage_sentences.join(boxes.select(F.col("display_id").alias("sentence"), "block_no"), "sentence")
    return under.groupBy("passage").agg(F.array_sort(F.collect_set("block_no")).alias("block_nos"))


def duplicate_keys(df: DataFrame, table: str, *keys: str) -> DataFrame:
    bad = df.groupBy(*keys).count().filter("count > 1")
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{table}: unique {', '.join(keys)}").alias("constraint"), "violations")


def orphans(child: DataFrame, parent: DataFrame, key: str, table: str) -> DataFrame:
    bad = child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{table}: {key} exists").alias("constraint"), "violations")


def outside(df: DataFrame, column: str, allowed: list, table: str) -> DataFrame:
    bad = df.filter(~F.col(column).isin(allowed))
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{table}: {column} allowed").alias("constraint"), "violations")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A child table's rows without those of deleted parents."""
    return child.join(deleted.select(key).distinct(), key, "left_anti")


def inactive(corpora: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """corpora: root, last_accessed_at (ISO text), valid. Those unused for so many days, the untracked and the invalid."""
    if days <= 0:
        raise ValueError("the number of days must be positive")
    at = F.try_to_timestamp(F.col("last_accessed_at"))
    cutoff = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days))
    status = F.when(~F.col("valid"), "invalid").when(at.isNull(), "untracked").when(at <= cutoff, "ready")
    return corpora.withColumn("status", status).filter("status IS NOT NULL")


def cleanup_outcomes(targets: DataFrame, apply: bool) -> DataFrame:
    """What a cleanup does: a preview, or all or nothing."""
    if not apply:
        return targets.withColumn("outcome", F.when(F.col("status") == "ready", "preview").otherwise(F.col("status")))
    bad = targets.agg(_n(F.col("status") == "invalid").alias("bad"))  # one row
    return targets.crossJoin(bad).withColumn("outcome", F.when(F.col("bad") > 0, F.col("status")).when(F.col("status") == "ready", "deleted").otherwise(F.col("status"))).drop("bad")
