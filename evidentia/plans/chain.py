"""The whole way from files to classified passages as JSON lines, without a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import chunk, classify, geometry, segment
from evidentia.sources import readers


def build_files(sources: DataFrame, out: str, make_decoder=readers.TextDecoder, max_words: int = chunk.MAX_WORDS, overlap: int = chunk.OVERLAP) -> str:
    """Writes documents, pages, errors, sentences, boxes and passages below ``out``, a folder of JSON lines each; gives a
    line on what there is. Each step reads what the one before wrote."""
    spark = sources.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        readers.write_json_lines(df, f"{out}/{name}")
        return spark.read.schema(df.schema).json(f"{out}/{name}")

    rows = readers.extract_rows(sources, make_decoder)
    saved = save(rows, "extracted")
    pages, words = readers.pages_of(saved), readers.words_of(readers.pages_of(saved))
    save(readers.errors_of(saved), "errors")
    documents = save(pages.groupBy("document_id", "source_path", "sha256").agg(F.count(F.lit(1)).cast("int").alias("page_count")), "documents")
    save(pages.drop("words", "drawings"), "pages")
    once = documents.groupBy("document_id").agg(F.min("source_path").alias("source_path"), F.first("page_count").alias("page_count"))
    own = pages.join(once.select("document_id", "source_path"), ["document_id", "source_path"], "left_semi")
    lines = own.filter("words IS NULL").select("document_id", "page_index", F.posexplode(F.split("text", "\n")).alias("logical_block_index", "block")).withColumn("logical_block_index", F.col("logical_block_index").cast("long"))
    words = words.join(own.select("document_id", "page_index").distinct(), ["document_id", "page_index"], "left_semi") if documents.count() == once.count() else readers.words_of(own)
    placed, boxes = geometry.cut(words)
    cut = segment.cut(lines)
    sentences = save(segment.number(cut.unionByName(placed.select(*cut.columns))), "sentences")
    key = ["document_id", "page_index", "logical_block_index", "pos"]
    boxes = save(boxes.join(sentences.select(*key, "display_id"), key), "boxes")
    passages = classify.numbered(chunk.passages(sentences, max_words, overlap)).join(once.select("document_id", "page_count"), "document_id")
    edges = geometry.top_edges(boxes, chunk.passage_sentences(passages)).withColumnRenamed("passage", "display_id")
    rules = classify.rule_cutoffs(classify.rule_candidates(readers.drawings_of(own), own), words, once)
    done = save(classify.classify(passages.join(edges, "display_id", "left"), classify.heading_cutoffs(passages), rules), "passages")
    return f"{documents.count()} documents, {sentences.count()} sentences, {done.count()} passages, {done.filter('retrieval_eligible').count()} to be searched"
