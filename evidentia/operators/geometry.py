"""Words with geometry: visual lines, logical blocks, their text, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import needs_space
from evidentia.operators.segment import split_sentences

#: Fixed values of the visual-line test.
MIN_HEIGHT, MIN_OVERLAP, CENTRE_SHARE, BACK_GAP, GAP = 1.0, 0.20, 0.65, 1.5, 2.5

PAGE = ["document_id", "page_index"]


def lines(words: DataFrame) -> DataFrame:
    """words: document_id, page_index, pos, text, x0, y0, x1, y1, block_no, line_no. One row per line with its box and order."""
    return words.groupBy(*PAGE, "block_no", "line_no").agg(
        F.min("pos").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def shares_visual_line(left: Column, right: Column, gap: float = GAP) -> Column:
    """left, right: boxes (struct x0, y0, x1, y1) of the last line of one block and the first of the next."""
    h = lambda b: F.greatest(b["y1"] - b["y0"], F.lit(MIN_HEIGHT))
    ref, low = F.greatest(h(left), h(right)), F.least(h(left), h(right))
    over = F.least(left["y1"], right["y1"]) - F.greatest(left["y0"], right["y0"])
    centre = F.abs((left["y0"] + left["y1"]) / 2 - (right["y0"] + right["y1"]) / 2)
    aligned = (F.greatest(over, F.lit(0.0)) / low >= MIN_OVERLAP) | (centre <= CENTRE_SHARE * ref)
    space = right["x0"] - left["x1"]
    return F.coalesce(aligned & (space >= -BACK_GAP * ref) & (space <= gap * ref), F.lit(False))


def logical_blocks(words: DataFrame, gap: float = GAP) -> DataFrame:
    """document_id, page_index, block_no, logical_block_index: blocks chained while each shares a visual line with the one before."""
    box = F.struct("x0", "y0", "x1", "y1")
    b = lines(words).groupBy(*PAGE, "block_no").agg(F.min("first").alias("first"), F.min_by(box, "first").alias("head"), F.max_by(box, "first").alias("tail"))
    w = Window.partitionBy(*PAGE).orderBy("first")
    joined = shares_visual_line(F.lag("tail").over(w), F.col("head"), gap)
    b = b.withColumn("new", F.when(joined, 0).otherwise(1))
    return b.select(*PAGE, "block_no", (F.sum("new").over(w) - 1).cast("long").alias("logical_block_index"))


def placed_words(words: DataFrame, groups: DataFrame) -> DataFrame:
    """Words with their half-open place in the logical block's text. Only a new line within a block counts as one here."""
    d = words.join(groups, [*PAGE, "block_no"])
    w = Window.partitionBy(*PAGE, "logical_block_index").orderBy("pos")
    first_line = F.min("line_no").over(Window.partitionBy(*PAGE, "block_no"))
    new_line = (F.lag("block_no").over(w) == F.col("block_no")) & (F.lag("line_no").over(w) != F.col("line_no")) & (F.col("line_no") != first_line)
    d = d.withColumn("space", needs_space(F.lag("text").over(w), F.col("text"), F.coalesce(new_line, F.lit(False))).cast("int"))
    end = F.sum(F.col("space") + F.length("text")).over(w)
    return d.withColumn("end", end.cast("long")).withColumn("start", (end - F.length("text")).cast("long"))


def block_text(placed: DataFrame) -> DataFrame:
    """The logical blocks' texts."""
    one = F.struct("pos", "space", "text")
    g = placed.groupBy(*PAGE, "logical_block_index").agg(F.array_sort(F.collect_list(one)).alias("w"), F.min_by("block_no", "pos").alias("primary_block_no"))
    return g.select(*PAGE, "logical_block_index", "primary_block_no", F.array_join(F.transform("w", lambda x: F.concat(F.when(x["space"] == 1, " ").otherwise(""), x["text"])), "").alias("text"))


def normalized_text(words_in_order: Column) -> Column:
    """words_in_order: array<struct<text, block_no, line_no>>. As block_text, but a block's or line's end counts as a line
    break, and a word cut by a hyphen there is joined if it is long enough and goes on in lower case."""

    def step(s: Column, w: Column) -> Column:
        broke = (s["block"] != w["block_no"]) | (s["line"] != w["line_no"])
        soft = broke & s["last"].rlike("-$") & (F.length(s["last"]) > 2) & w["text"].rlike(r"^\p{Ll}")
        text = (
            F.when(s["text"] == "", w["text"])
            .when(soft, F.concat(F.regexp_replace(s["text"], "-$", ""), w["text"]))
            .when(needs_space(s["last"], w["text"], broke), F.concat(s["text"], F.lit(" "), w["text"]))
            .otherwise(F.concat(s["text"], w["text"]))
        )
        return F.struct(text.alias("text"), w["text"].alias("last"), w["block_no"].cast("long").alias("block"), w["line_no"].cast("long").alias("line"))

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("last"), F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("line"))
    return F.aggregate(words_in_order, start, step, lambda s: s["text"])


def word_sentence_overlap(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Words under each sentence: half-open ranges that overlap, within a block, which is the equality of the join."""
    key = [*PAGE, "logical_block_index"]
    s = spans.select(*key, "sentence_index", F.col("start").alias("s0"), F.col("end").alias("s1"))
    return placed.join(s, key).filter((F.col("end") > F.col("s0")) & (F.col("start") < F.col("s1")))


def line_boxes(sentence_words: DataFrame) -> DataFrame:
    """A sentence's boxes, one per block and line, in the order in which they come, rounded to three places."""
    key = [*PAGE, "logical_block_index", "sentence_index"]
    r = lambda f, c: F.round(f(c), 3).alias(c)
    g = sentence_words.groupBy(*key, "block_no", "line_no").agg(F.min("pos").alias("first"), r(F.min, "x0"), r(F.min, "y0"), r(F.max, "x1"), r(F.max, "y1"))
    w = Window.partitionBy(*key).orderBy("first")
    return g.withColumn("box_index", F.row_number().over(w).cast("long") - 1).drop("first")


def sentence_text(sentence_words: DataFrame) -> DataFrame:
    """Normalised text, number of words and first block of each sentence."""
    key = [*PAGE, "logical_block_index", "sentence_index"]
    g = sentence_words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "block_no", "line_no"))).alias("w"))
    words = F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["block_no"].alias("block_no"), x["line_no"].alias("line_no")))
    return g.select(*key, normalized_text(words).alias("normalized_text"), F.size("w").cast("long").alias("source_word_count"), F.element_at("w", 1)["block_no"].alias("primary_block_no"))


def cut(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences of pages from their words, as segment.cut, and the sentences' boxes (keyed by page, block and pos).

    Words of a page without any give no rows. Words are joined by single spaces, so a sentence begins one place after the
    one before it ends.
    """
    placed = placed_words(words, logical_blocks(words))
    key = [*PAGE, "logical_block_index"]
    rows = block_text(placed).select(*key, F.posexplode(split_sentences("text")).alias("pos", "source_text"))
    w = Window.partitionBy(*key).orderBy("pos")
    end = F.sum(F.length("source_text") + 1).over(w) - 1
    spans = rows.withColumn("end", end).select(*key, F.col("pos").alias("sentence_index"), (F.col("end") - F.length("source_text")).alias("start"), "end")
    under = word_sentence_overlap(placed, spans)
    texts = sentence_text(under).withColumnRenamed("sentence_index", "pos")
    return rows.join(texts, [*key, "pos"]), line_boxes(under).withColumnRenamed("sentence_index", "pos")


def top_edges(boxes: DataFrame, passage_sentences: DataFrame) -> DataFrame:
    """passage, top_y: the top edge of each passage (null without boxes). boxes: display_id, y0."""
    return passage_sentences.join(boxes.select(F.col("display_id").alias("sentence"), "y0"), "sentence", "left").groupBy("passage").agg(F.min("y0").alias("top_y"))
