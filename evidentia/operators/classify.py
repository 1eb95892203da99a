"""End matter: terminal headings, bibliography likeness, rules across the page."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import col

#: Section families and their headings, in the order in which they are tried.
HEADINGS = (
    ("references", "references?"),
    ("references", r"references?\s+and\s+notes?"),
    ("references", "bibliography"),
    ("references", r"literature\s+cited"),
    ("references", r"works\s+cited"),
    ("acknowledgements", "acknowledge?ments?"),
    ("author_contributions", r"author\s+contributions?"),
    ("author_contributions", r"authors?['’]?\s+contributions?"),
    ("author_contributions", r"credit\s+authorship\s+contribution\s+statement"),
    ("author_contributions", r"author\s+statement"),
    ("conflicts_of_interest", r"conflicts?\s+of\s+interest"),
    ("conflicts_of_interest", r"conflicting\s+interests?"),
    ("conflicts_of_interest", r"competing\s+interests?"),
    ("conflicts_of_interest", r"declaration\s+of\s+competing\s+interest"),
    ("conflicts_of_interest", r"declarations?\s+of\s+interest"),
    ("data_availability", r"data\s+availability"),
    ("data_availability", r"data\s+availability\s+statement"),
    ("data_availability", r"data\s+and\s+code\s+availability"),
    ("data_availability", r"code\s+availability"),
    ("data_availability", r"availability\s+of\s+data"),
    ("funding", "funding"),
    ("funding", r"funding\s+information"),
)
#: Each heading has one of these in it.
STEMS = ("reference", "bibliography", "cited", "acknowl", "author", "interest", "availability", "funding")
SYMBOLS, DASHES = "■▪◆●□▸►", "\\-–—:"
#: A heading counts at the passage's start (after symbols, dashes and a section number), after a structural
#: symbol, or as the last words of the passage after a sentence's end.
#: Placements, in the order in which they are tried for each heading: group 1 is what stands before it, 2 the heading.
PLACEMENTS = (
    ("passage_start", rf"(?i)^(\s*[{SYMBOLS}{DASHES}]*\s*(?:(?:\d+(?:\.\d+)*|[IVXLCDM]+)[.)]?\s+)?)(%s)\s*[:.\-–—]?(?:\s|$)"),
    ("structural_symbol", rf"(?i)^(.*?[{SYMBOLS}]\s*)(%s)\s*[:.\-–—]?(?:\s|$)"),
    ("passage_end", rf"(?i)^(.*?[.!?]\s+[{SYMBOLS}{DASHES}]*\s*)(%s)\s*[:.\-–—]?\s*$"),
)
FIRST_PART, EARLY = 0.40, 0.25


def terminal_heading(text: Column | str) -> Column:
    """struct<section, placement, heading, position> of the first hit in the order of headings, then placements; null if none."""
    t = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    words = "|".join(dict.fromkeys(h for _, h in HEADINGS))

    def hit(x: Column) -> Column:
        tries = []
        for section, heading in HEADINGS:
            for placement, pattern in PLACEMENTS:
                p = pattern % heading
                found = F.struct(F.lit(section).alias("section"), F.lit(placement).alias("placement"), F.regexp_extract(x, p, 2).alias("heading"), F.length(F.regexp_extract(x, p, 1)).cast("long").alias("position"))
                tries.append(F.when(x.rlike(p), found))
        return F.coalesce(*tries)

    # most passages hold no stem of a heading at all, which is told faster than by the pattern; within lambdas the many
    # tries are not compiled into one method
    both = F.transform(F.array(t), lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    some = lambda y: reduce(or_, [F.contains(y["low"], F.lit(s)) for s in STEMS])
    return F.get(F.transform(both, lambda y: F.when(some(y), F.when(y["low"].rlike(words), hit(y["x"])))), F.lit(0))


#: A year from 1800 to 2099, a DOI, "et al.", and a line that begins with a number in brackets or with a point.
YEAR, DOI, ET_AL = r"(?i)\b(?:18|19|20)\d{2}[a-z]?\b", r"(?i)\bdoi\s*:|\b10\.\d{4,9}/", r"(?i)\bet\s+al\."
NUMBERED = r"^\s*(?:\[\s*\d+\s*\]|\d{1,4}[.)])\s+"


def reference_likeness(text: Column | str) -> Column:
    """struct<numbered, years, dois, et_al, likely>: how much a text looks like a bibliography."""
    t = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    n = F.size(F.filter(lines, lambda x: F.concat(F.trim(x), F.lit(" ")).rlike(NUMBERED) & F.trim(x).rlike(NUMBERED))).cast("long")
    years, dois, et_al = (F.regexp_count(t, F.lit(p)).cast("long") for p in (YEAR, DOI, ET_AL))
    likely = (n >= 2) | (years >= 3) & (dois >= 1) | (years >= 5) & (et_al >= 1) | (years >= 7)
    return F.struct(n.alias("numbered"), years.alias("years"), dois.alias("dois"), et_al.alias("et_al"), likely.alias("likely"))


def _in_last_part(page_index: Column, page_count: Column) -> Column:
    return page_index >= F.floor(page_count * F.lit(FIRST_PART))


def heading_cutoffs(passages: DataFrame) -> DataFrame:
    """passages: document_id, page_index, page_count, idx (place in the document), source_text. One row per document with a hit."""
    seen = passages.filter(_in_last_part(F.col("page_index"), F.col("page_count"))).withColumn("hit", terminal_heading("source_text")).filter("hit IS NOT NULL")
    first = seen.groupBy("document_id").agg(F.min_by(F.struct("idx", "hit", _part().alias("part")), "idx").alias("m"))
    return first.select("document_id", F.col("m.hit.section").alias("section"), F.col("m.hit.placement").alias("placement"), F.round("m.part", 6).alias("relative_position"), _cutoff("m").alias("cutoff"))


def _part() -> Column:
    return F.col("hit.position") / F.greatest(F.lit(1), F.length("source_text"))


def _cutoff(first: str) -> Column:
    return F.when(F.col(f"{first}.part") <= EARLY, F.col(f"{first}.idx")).otherwise(F.col(f"{first}.idx") + 1).cast("long")


def classify_by_headings(passages: DataFrame) -> DataFrame:
    """classify(passages, heading_cutoffs(passages)) for passages that are costly to make: they are made once, and what is
    shuffled is their places and hits, without texts that nobody asks for afterwards."""
    hit = F.when(_in_last_part(F.col("page_index"), F.col("page_count")), terminal_heading("source_text"))
    d = passages.withColumn("hit", hit)
    d = d.withColumn("at", F.when(F.col("hit").isNotNull(), F.struct("idx", _part().alias("part")))).drop("hit")
    d = d.withColumn("m", F.min("at").over(Window.partitionBy("document_id")))
    return _marked(d, F.col("idx") >= _cutoff("m")).drop("at", "m")


def rule_candidates(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Nearly horizontal lines and thin rectangles that span 40 % of the page, away from its head and foot."""
    d = drawings.join(pages.select("document_id", "page_index", "width", "height"), ["document_id", "page_index"])
    x0, x1 = F.least("x0", "x1"), F.greatest("x0", "x1")
    tall = F.abs(F.col("y1") - F.col("y0"))
    flat = F.when(F.col("kind") == "line", tall <= 1.5).when(F.col("kind") == "rect", tall <= 3.0).otherwise(False)
    y = (F.col("y0") + F.col("y1")) / 2
    wide = (x1 - x0) >= 0.4 * F.col("width")
    out = d.filter(flat & wide & (y >= 0.10 * F.col("height")) & (y <= 0.92 * F.col("height")))
    return out.select("document_id", "page_index", "seq", y.alias("y"), x0.alias("x0"), x1.alias("x1"), (x1 - x0).alias("width"), F.col("kind").alias("source"))


def rule_cutoffs(rules: DataFrame, words: DataFrame, page_counts: DataFrame) -> DataFrame:
    """For each document the first rule, from 40 % of its pages on, with a bibliography below it."""
    late = rules.join(page_counts, "document_id").filter(_in_last_part(F.col("page_index"), F.col("page_count")))
    below = late.select("document_id", "page_index", "seq", "y").join(words.select("document_id", "page_index", "pos", "text", F.col("y0").alias("wy"), "line_no", "block_no"), ["document_id", "page_index"]).filter(F.col("wy") >= F.col("y") + 2)
    lines = below.groupBy("document_id", "page_index", "seq", "y", "block_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("line"))
    text = lines.groupBy("document_id", "page_index", "seq", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    hits = text.filter(reference_likeness("text")["likely"])
    return hits.groupBy("document_id").agg(F.min(F.struct("page_index", "y", "seq")).alias("m")).select("document_id", F.col("m.page_index").alias("rule_page"), F.col("m.y").alias("rule_y"))


def classify(passages: DataFrame, headings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds content_type and takes eligibility from end matter. A document's heading comes first; only without one its rule counts.

    passages also has top_y where rules are given.
    """
    d = passages.join(headings.select("document_id", "cutoff"), "document_id", "left")
    end = F.col("idx") >= F.col("cutoff")
    if rules is not None:
        d = d.join(rules, "document_id", "left")
        under = (F.col("page_index") > F.col("rule_page")) | (F.col("page_index") == F.col("rule_page")) & (F.col("top_y") > F.col("rule_y"))
        end = F.when(F.col("cutoff").isNotNull(), end).otherwise(under)
    return _marked(d, end).drop("cutoff", "rule_page", "rule_y")


def _marked(d: DataFrame, end: Column) -> DataFrame:
    d = d.withColumn("content_type", F.when(F.coalesce(end, F.lit(False)), "end_matter").otherwise("body"))
    return d.withColumn("retrieval_eligible", F.col("retrieval_eligible") & (F.col("content_type") == "body"))


def numbered(passages: DataFrame) -> DataFrame:
    """idx: each passage's place in its document."""
    w = Window.partitionBy("document_id").orderBy("page_index", "logical_block_index", "block_passage_index")
    return passages.withColumn("idx", F.row_number().over(w).cast("long") - 1)


def report(classified: DataFrame) -> DataFrame:
    """Per document: passages, end matter, eligible passages."""
    count = lambda c: F.count_if(c).cast("long")
    return classified.groupBy("document_id").agg(F.count(F.lit(1)).alias("passages"), count(F.col("content_type") == "end_matter").alias("end_matter"), count(F.col("retrieval_eligible")).alias("eligible"))
