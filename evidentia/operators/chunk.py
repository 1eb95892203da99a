"""Overlapping passages from ordered sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import trim, word_count

MAX_WORDS, OVERLAP, LEAST_WORDS = 180, 1, 8


def check(max_words: int, overlap: int) -> None:
    if max_words <= 0:
        raise ValueError("max_words must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")


def spans(counts: list[int], max_words: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open ranges of sentences: as many as fit, at least one; the next range goes back by the overlap, and on by one at least."""
    out, start, n = [], 0, len(counts)
    while start < n:
        end, words = start + 1, counts[start]
        while end < n and words + counts[end] <= max_words:
            words += counts[end]
            end += 1
        out.append((start, end))
        if end == n:
            break
        start = max(start + 1, end - overlap)
    return out


def with_spans(df: DataFrame, counts: str, max_words: int, overlap: int) -> DataFrame:
    """Adds spans: array<struct<a, b>>, from an array of word counts. Each range depends on the one before, so it is a
    fold; as nested lambdas it is far slower than as a vectorized function over the counts alone."""
    check(max_words, overlap)

    @F.pandas_udf("array<int>")
    def fold(c: pd.Series) -> pd.Series:
        return c.map(lambda x: [v for ab in spans(list(x), max_words, overlap) for v in ab])

    df = df.withColumn("__flat", fold(counts))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("__flat")), lambda i: (i % 2 == 0) & (i < F.size("__flat"))), lambda i: F.struct(F.get("__flat", i).alias("a"), F.get("__flat", i + 1).alias("b")))
    return df.withColumn("spans", pairs).drop("__flat")


def passages(sentences: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Passages of each (document, page, block); they never cross it. One row per passage with its sentence ids, the places
    of its first and last sentence on the page, and its normalised text where the sentences have one."""
    normal = "normalized_text" if "normalized_text" in sentences.columns else "source_text"
    one = F.struct(F.col("block_sentence_index").alias("i"), F.col("display_id").alias("id"), trim("source_text").alias("t"), trim(normal).alias("m"), F.col("source_word_count").alias("n"), F.col("page_sentence_index").alias("at"))
    return _passages(sentences.groupBy("document_id", "page_index", "logical_block_index").agg(F.array_sort(F.collect_list(one)).alias("s")), max_words, overlap)


def of_blocks(blocks: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """The same of rows of segment.page_blocks(), where a block's sentences lie together; nothing is shuffled. parts has each
    passage's sentences: id, t."""
    one = lambda x: F.struct(x["block_sentence_index"].alias("i"), x["display_id"].alias("id"), x["source_text"].alias("t"), x["source_text"].alias("m"), word_count(x["source_text"]).alias("n"), x["page_sentence_index"].alias("at"))
    return _passages(blocks.select("document_id", "page_index", "logical_block_index", F.transform("s", one).alias("s")), max_words, overlap, True)


def _passages(grouped: DataFrame, max_words: int, overlap: int, parts: bool = False) -> DataFrame:
    counted = grouped.withColumn("counts", F.transform("s", lambda x: x["n"]))
    # outer, as else Spark filters by the spans' number first, and makes the spans twice for that
    cut = with_spans(counted, "counts", max_words, overlap).select("document_id", "page_index", "logical_block_index", "s", F.posexplode_outer("spans").alias("pos", "span")).filter("span IS NOT NULL")
    part = F.slice("s", F.col("span.a") + 1, F.col("span.b") - F.col("span.a"))
    text = lambda c: F.array_join(F.transform("part", lambda x: x[c]), " ")
    out = cut.select("document_id", "page_index", "logical_block_index", F.col("pos").cast("long").alias("block_passage_index"), part.alias("part"))
    out = out.withColumns({"sentence_ids": F.transform("part", lambda x: x["id"]), "source_text": text("t"), "normalized_text": text("m"), "first_sentence": F.element_at("part", 1)["at"], "last_sentence": F.element_at("part", -1)["at"]})
    return out.select(
        F.format_string("%s:p%04d:lb%04d:c%03d", F.col("document_id").cast("string"), F.col("page_index") + 1, F.col("logical_block_index"), F.col("block_passage_index")).alias("display_id"),
        "document_id", "page_index", "logical_block_index", "block_passage_index", "sentence_ids", "source_text", "normalized_text", "first_sentence", "last_sentence",
        word_count("source_text").alias("word_count"), F.size("sentence_ids").cast("long").alias("sentence_count"), (word_count("source_text") >= LEAST_WORDS).alias("retrieval_eligible"),
        *([F.transform("part", lambda x: F.struct(x["id"].alias("id"), x["t"].alias("t"))).alias("parts")] if parts else []),
    )


def passage_sentences(passages_: DataFrame) -> DataFrame:
    """passage, sentence, position from 0."""
    return passages_.select(F.col("display_id").alias("passage"), F.posexplode("sentence_ids").alias("position", "sentence")).select("passage", "sentence", F.col("position").cast("long").alias("position"))
