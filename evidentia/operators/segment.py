"""Sentences: terminators, abbreviations, citation boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import SPACE, col, trim, word_count

#: Texts that end like this do not end a sentence. A plain suffix test, without a word boundary.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "fig.", "figs.", "eq.", "eqs.", "sec.", "secs.", "sect.", "sects.", "ref.", "refs.", "no.", "nos.", "dr.", "prof.", "vs.", "cf.", "approx.")
ABBREVIATION = "(" + "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS) + ")$"
INITIAL = r"(^|[^0-9A-Za-z_])[A-Z][.]$"
#: Characters at a text's end in which either shows: the longest abbreviation's, and a line end after it.
TAIL = max(map(len, ABBREVIATIONS)) + 3

MARK = "\x1f"
TERMINATOR = "([.!?…][\"”’)\\]]*)\\s+"
_DASH = "‐‑‒–—−"
_LIST = rf"\d+(?:\s*[,;\-{_DASH}]\s*\d+)*"
#: Fixed value: a numeric citation right after a sentence's end (a letter or closing bracket, then the mark) belongs to
#: that sentence, and a capital after it begins the next one. The capital is only looked at, as it may be all of it.
CITATION = rf"([A-Za-z)\]][.!?](?:\[\s*{_LIST}\s*\]|\(\s*{_LIST}\s*\)|{_LIST}))\s+(?=[A-Z])"


def looks_like_abbreviation(text: Column | str) -> Column:
    """Only the end is looked at: the patterns tried at every place of a text take most of the time of cutting it."""
    t = F.right(F.rtrim(col(text), F.lit(SPACE)), F.lit(TAIL))
    return F.lower(t).rlike(ABBREVIATION) | t.rlike(INITIAL)


def split_sentences(text: Column | str) -> Column:
    """Array of a block's sentences, trimmed; white space at their joints is dropped. Blank text has none.

    Whether a part ends a sentence shows in the part itself, so parts are joined again with a space or a mark after each
    and cut at the marks: linear in the text.
    """
    parts = F.filter(F.split(F.regexp_replace(trim(F.coalesce(col(text), F.lit(""))), TERMINATOR, f"$1{MARK}"), MARK), lambda x: x.rlike(r"\S"))
    merged = F.array_join(F.transform(parts, lambda x: F.concat(x, F.when(looks_like_abbreviation(x), " ").otherwise(MARK))), "")
    cut = F.split(F.regexp_replace(merged, CITATION, f"$1{MARK}"), MARK)
    return F.filter(F.transform(cut, trim), lambda x: x != "")


def blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_id, page_index, logical_block_index, block: a text's lines as blocks of its one page; blank blocks keep their number but have no sentence."""
    lines = documents.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("logical_block_index", "block"))
    return lines.select("document_id", F.lit(0).cast("long").alias("page_index"), F.col("logical_block_index").cast("long").alias("logical_block_index"), trim("block").alias("block"))


def cut(blocks_: DataFrame) -> DataFrame:
    """A row for each sentence of each block, with its place in it (pos). The text as it is also counts as normalised."""
    rows = blocks_.select("document_id", "page_index", "logical_block_index", F.posexplode(split_sentences("block")).alias("pos", "source_text"))
    return rows.withColumns({"normalized_text": F.col("source_text"), "source_word_count": word_count("source_text"), "primary_block_no": F.col("logical_block_index")})


def number(rows: DataFrame) -> DataFrame:
    """Adds each sentence's place in block, page and document, its display id and its length."""
    order = ["page_index", "logical_block_index", "pos"]
    doc = Window.partitionBy("document_id").orderBy(*order)
    page = Window.partitionBy("document_id", "page_index").orderBy(*order[1:])
    rows = rows.withColumn("document_sentence_index", F.row_number().over(doc).cast("long") - 1).withColumn("page_sentence_index", F.row_number().over(page).cast("long") - 1)
    return rows.withColumns(
        {
            "block_sentence_index": F.col("pos").cast("long"),
            "display_id": F.format_string("%s:p%04d:s%03d", F.col("document_id").cast("string"), F.col("page_index") + 1, F.col("page_sentence_index")),
            "character_count": F.length("source_text").cast("long"),
        }
    )


def sentences(blocks_: DataFrame) -> DataFrame:
    """The numbered sentences of blocks of text."""
    return number(cut(blocks_)).select("document_id", "page_index", "logical_block_index", "block_sentence_index", "page_sentence_index", "document_sentence_index", "display_id", "source_text", "character_count", "source_word_count")


# --- documents of one page each, without a shuffle: what needs a page's or a block's other sentences finds them in its row.
# Arrays are taken apart by explode_outer, and nulls are dropped afterwards: for explode, Spark adds a filter by the array's
# size and moves it down to the texts, which are then cut twice.


def display(document_id: Column | str, page_sentence_index: Column) -> Column:
    """A sentence's display id on its document's first page."""
    n = page_sentence_index.cast("string")  # by hand, as format_string takes as long as cutting the sentence
    return F.concat(col(document_id).cast("string"), F.lit(":p0001:s"), F.when(page_sentence_index < 1000, F.lpad(n, 3, "0")).otherwise(n))


def pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_id, s: a row for each document with the sentences of its lines, in order: logical_block_index,
    block_sentence_index, page_sentence_index, display_id, source_text. The same sentences as of blocks()."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    nested = F.transform(lines, lambda b, i: F.transform(split_sentences(b), lambda t, j: F.struct(i.alias("lb"), j.alias("pos"), t.alias("t"))))
    flat = documents.select(F.col(id_col).alias("document_id"), F.flatten(nested).alias("s"))
    one = lambda x, i: F.struct(x["lb"].cast("long").alias("logical_block_index"), x["pos"].cast("long").alias("block_sentence_index"), i.cast("long").alias("page_sentence_index"), display("document_id", i).alias("display_id"), x["t"].alias("source_text"))
    return flat.select("document_id", F.transform("s", one).alias("s"))


def document_sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sentences(blocks(documents)), numbered within each document's row."""
    rows = pages(documents, id_col, text_col).select("document_id", F.lit(0).cast("long").alias("page_index"), F.explode_outer("s").alias("x")).filter("x IS NOT NULL").select("document_id", "page_index", "x.*")
    rows = rows.withColumns({"document_sentence_index": F.col("page_sentence_index"), "character_count": F.length("source_text").cast("long"), "source_word_count": word_count("source_text")})
    return rows.select("document_id", "page_index", "logical_block_index", "block_sentence_index", "page_sentence_index", "document_sentence_index", "display_id", "source_text", "character_count", "source_word_count")


def page_blocks(pages_: DataFrame) -> DataFrame:
    """A row for each block that has sentences, of rows of pages(): document_id, page_index, logical_block_index, s (its own)."""
    begin = F.filter(F.transform("s", lambda x, i: F.when(x["block_sentence_index"] == 0, i)), lambda i: i.isNotNull())
    d = pages_.withColumn("begin", begin)
    own = F.transform("begin", lambda p, k: F.slice("s", p + 1, F.coalesce(F.get("begin", k + 1), F.size("s")) - p))
    rows = d.select("document_id", F.lit(0).cast("long").alias("page_index"), F.explode_outer(own).alias("s")).filter("s IS NOT NULL")
    return rows.select("document_id", "page_index", F.get("s", F.lit(0))["logical_block_index"].alias("logical_block_index"), "s")
