"""Looking at sentences: details, contexts, what to render; sentence-level search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import html_escape
from evidentia.operators import judge


class MissingRows(LookupError):
    """Some requested ids do not exist; nothing was produced."""


def in_request_order(requested: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """requested: ids (array). Rows of known ids in the order of the request; unknown ones are dropped, repeated ones come once."""
    asked = requested.select(F.posexplode(F.array_distinct("ids")).alias("request_pos", id_col))
    return asked.join(rows, id_col).withColumn("request_pos", F.col("request_pos").cast("long"))


def missing(requested: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    return requested.select(F.explode(F.array_distinct("ids")).alias(id_col)).join(rows, id_col, "left_anti")


def require_all(requested: DataFrame, rows: DataFrame, id_col: str) -> None:
    gone = missing(requested, rows, id_col).limit(10).collect()
    if gone:
        raise MissingRows(", ".join(str(r[0]) for r in gone))


def context_window(rows: DataFrame, partition: list[str], order: str, text: str, before: int, after: int) -> DataFrame:
    """context: the texts of the neighbours within the partition, clipped at both ends, joined by spaces."""
    if before < 0 or after < 0:
        raise ValueError("a context must not be negative")
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn("context", F.array_join(F.collect_list(F.col(text)).over(w), " "))


def page_context(sentences: DataFrame, wanted: DataFrame, n: int = 2) -> DataFrame:
    """For each wanted display_id its page's sentences within n, with is_target. Each asks for the 2n + 1 places around its
    own, so a long page costs no more."""
    if n < 0:
        raise ValueError("a context must not be negative")
    target = sentences.join(wanted.select("display_id").distinct(), "display_id", "left_semi")
    places = F.explode(F.sequence(F.col("page_sentence_index") - n, F.col("page_sentence_index") + n)).alias("page_sentence_index")
    target = target.select(F.col("display_id").alias("target"), "document_id", "page_index", places)
    near = target.join(sentences, ["document_id", "page_index", "page_sentence_index"])
    return near.select("target", "display_id", "page_sentence_index", "source_text", (F.col("display_id") == F.col("target")).alias("is_target"))


def near(items: Column | str, i: Column, n: int) -> Column:
    """The elements of an array within n places of place i (from 0), clipped at both ends."""
    if n < 0:
        raise ValueError("a context must not be negative")
    first = F.greatest(i - n, F.lit(0))
    return F.slice(items, first + 1, i + n + 1 - first)


def details(sentences: DataFrame, boxes: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Sentences with their page, their document and their boxes in order."""
    b = boxes.groupBy("display_id").agg(F.array_sort(F.collect_list(F.struct("box_index", "block_no", "line_no", "x0", "y0", "x1", "y1"))).alias("boxes"))
    p = pages.select("document_id", "page_index", "page_number", "width", "height", "rotation", "extraction_status")
    d = documents.select("document_id", "sha256", "stored_path", "filename", "title", display_name().alias("name"))
    return sentences.join(p, ["document_id", "page_index"]).join(d, "document_id").join(b, "display_id", "left")


def with_names(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with their document's name; a document that isn't there is called by its id."""
    named = documents.select("document_id", "title", "filename").distinct()
    return rows.join(named, "document_id", "left").withColumn("name", display_name()).drop("title", "filename")


def render_plan(requested: DataFrame, sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per page to draw, in the order in which the request comes to it, with the file's name."""
    rows = in_request_order(requested, sentences, "display_id").join(documents.select("document_id", "stored_path"), "document_id")
    g = rows.groupBy("stored_path", "page_index").agg(F.min("request_pos").alias("first"), F.array_sort(F.collect_list(F.struct("request_pos", "display_id"))).alias("s"))
    ids = F.transform("s", lambda x: x["display_id"])
    return g.select("first", "stored_path", "page_index", ids.alias("sentence_ids"), image_name("stored_path", F.col("page_index"), ids).alias("output"))


def image_name(stored_path: Column | str, page_index: Column, ids: Column) -> Column:
    """The file of a page's image, by the document's file, the page and the sentences that are marked."""
    stem = F.regexp_replace(F.element_at(F.split(stored_path, "/"), -1), r"\.[^.]*$", "")
    digest = F.substring(F.sha2(F.array_join(ids, "\x00"), 256), 1, 12)
    return F.format_string("%s_page_%04d_%s.png", stem, page_index + 1, digest)


def sentence_candidates(passages: DataFrame, passage_sentences: DataFrame, k: int = 30) -> DataFrame:
    """passages: claim_id, passage_id, passage_rank. Distinct sentences of the k best passages, each with its best parent."""
    some = passages.filter(F.col("passage_rank") <= k).join(passage_sentences, "passage_id")
    w = Window.partitionBy("claim_id", "sentence_id").orderBy("passage_rank", "position")
    return some.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def passage_context(candidates: DataFrame, passage_sentences: DataFrame, n: int = 0) -> DataFrame:
    """Adds context: the texts within n sentences in the parent passage, clipped at both ends; without a place in the
    passage the sentence itself. passage_sentences: passage_id, position, sentence_id, text."""
    if n < 0:
        raise ValueError("a context must not be negative")
    near = context_window(passage_sentences, ["passage_id"], "position", "text", n, n).select("passage_id", "position", "context")
    return candidates.join(near, ["passage_id", "position"], "left").withColumn("context", F.coalesce("context", "text"))


def rerank_sentences(candidates: DataFrame, passage_sentences: DataFrame, make_reranker=None, k: int = 10, context: int = 0) -> DataFrame:
    """Sentence candidates (claim_id, claim, sentence_id, text, passage_id, passage_rank, position), each scored with its
    context, and the k best by logit; ties go to the better passage and the earlier place. Without a reranker the share of
    the claim's terms scores."""
    d = passage_context(candidates, passage_sentences, context)
    w = Window.partitionBy("claim_id").orderBy("passage_rank", "position", "sentence_id")
    d = d.withColumnRenamed("text", "sentence").withColumnRenamed("context", "text").withColumn("fusion_rank", F.row_number().over(w).cast("long"))
    all_ = 1 << 31
    if make_reranker is None:
        p = F.round(judge.overlap("claim", "text"), 6)
        ranked = judge.rank_reranked(d.withColumn("rerank_score", p).withColumn("rerank_logit", F.round(judge.logit(F.col("rerank_score")), 6)), "rerank_logit")
    else:
        ranked = judge.rerank_model(d, make_reranker, all_, "rerank_logit")
    return ranked.filter(F.col("rerank_rank") <= k).withColumnRenamed("text", "context").drop("fusion_rank")


def extraction_review(pages: DataFrame) -> DataFrame:
    """document_id, html: a page for reading what was extracted, one section per page of the document."""
    one = F.concat(F.lit("<section><h2>Page "), F.col("page_number").cast("string"), F.lit(": "), F.col("extraction_status"), F.lit("</h2><pre>"), html_escape("extracted_text"), F.lit("</pre></section>"))
    g = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_index", one.alias("s")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["s"]), "\n")
    return g.select("document_id", F.concat(F.lit('<!doctype html><meta charset="utf-8"><h1>'), html_escape("document_id"), F.lit("</h1>\n"), body).alias("html"))


def display_name(title: Column | str = "title", filename: Column | str = "filename", document_id: Column | str = "document_id") -> Column:
    c = lambda x: F.nullif(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return F.coalesce(c(title), c(filename), c(document_id))
