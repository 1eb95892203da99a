"""Duplicates, outcomes and metadata of an ingestion batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("ask", "discard", "replace")
#: What a caller may set of a document, and what an embedded title, author and subject become.
METADATA = ("title", "authors", "publication_year", "journal", "volume", "issue", "page_range", "doi", "abstract", "citation_key")


def exact_dedup(sources: DataFrame, order: str = "source_path") -> tuple[DataFrame, DataFrame]:
    """First source of each content, and the others. Only digests and names are grouped; sources are held against the
    result, so the contents of many copies never meet in one task."""
    first = sources.groupBy(F.col("sha256").alias("__sha256")).agg(F.min(order).alias("__first"))
    key = (F.col("sha256") == F.col("__sha256")) & F.col(order).eqNullSafe(F.col("__first"))
    return sources.join(first, key, "left_semi"), sources.join(first, key, "left_anti")


def outcomes(batch: DataFrame, existing: DataFrame, policy: str = "ask") -> DataFrame:
    """batch: source_path, sha256 (and error_type). Each source's status: added, discarded, replaced, failed.

    A source whose content can't be read has failed, and so has each copy of it.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown duplicate policy: {policy}")
    firsts = batch.filter("error_type IS NULL").groupBy("sha256").agg(F.min("source_path").alias("first"))
    known = existing.select("sha256").distinct().withColumn("known", F.lit(True))
    d = batch.join(firsts, "sha256", "left").join(known, "sha256", "left")
    again = F.col("known").isNotNull() | (F.col("source_path") != F.col("first"))
    told = {"ask": "failed", "discard": "discarded", "replace": "replaced"}[policy]
    status = F.when(F.col("error_type").isNotNull(), "failed").when(again, told).otherwise("added")
    return d.select("source_path", "sha256", status.alias("status"))


def replace_metadata(documents: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Name, path and given metadata of replaced documents; ids and texts stay. changes: sha256, source_path and any
    columns, null meaning no change. Of several changes of one document the one with the last path counts."""
    names = [c for c in changes.columns if c != "sha256" and c in documents.columns]
    last = changes.groupBy("sha256").agg(F.max_by(F.struct(*names), "source_path").alias("__new"))
    d = documents.join(last, "sha256", "left")
    hit = F.col("__new").isNotNull()
    cols = [F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in names else F.when(hit, at).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in documents.columns]
    return d.select(*cols)


def metadata(embedded: str = "metadata", given: dict | None = None) -> dict[str, Column]:
    """Document columns from a map of embedded metadata: title, author (the only one of the authors), subject (the
    abstract); empty text counts as none. Given values that aren't null win; other names are an error."""
    c = lambda x: F.nullif(F.trim(F.try_element_at(embedded, F.lit(x))), F.lit(""))
    found = {"title": c("title"), "authors": F.when(c("author").isNotNull(), F.array(c("author"))), "abstract": c("subject")}
    return found | overrides(given)


def overrides(given: dict | None) -> dict[str, Column]:
    unknown = set(given or {}) - set(METADATA)
    if unknown:
        raise ValueError(f"unknown metadata: {', '.join(sorted(unknown))}")
    return {k: F.array(*[F.lit(a) for a in v]) if k == "authors" else F.lit(v) for k, v in (given or {}).items() if v is not None}
