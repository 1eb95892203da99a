"""Queries over small inline tables, for what the synthetic tables never show. Their oracles state the expected rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import classify, fusion, geometry, judge, report, review, segment
from evidentia.plans import ingest
from evidentia.plans.corpus import Corpus
from evidentia.sources import readers, scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(columns: str, *rows: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"
        return f

    return add


@query("id, section, placement, position", "(1, 'references', 'passage_start', 0)", "(2, 'references', 'passage_start', 4)", "(3, 'acknowledgements', 'passage_start', 2)", "(4, 'references', 'passage_end', 19)", "(6, 'funding', 'structural_symbol', 13)")
def terminal_headings(spark, d):
    rows = [(1, "REFERENCES 1. Foo"), (2, "VI. References"), (3, "■ Acknowledgments We thank"), (4, "results were good. References"), (5, "The references were checked by hand"), (6, "good result ■Funding: none")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("h", classify.terminal_heading("t")).filter("h IS NOT NULL")
    return df.select("id", "h.section", "h.placement", F.col("h.position").cast("int").alias("position"))


@query("document_id, cutoff", "('b', 4)", "('c', 6)")
def heading_cutoff(spark, d):
    """Ten pages: a heading on page index 3 is too early, on 4 it counts; far into its passage it takes the next one."""
    rows = [("a", 3, 3, "References"), ("b", 3, 3, "References"), ("b", 4, 4, "References Foo"), ("c", 5, 5, "long text goes here. References")]
    df = spark.createDataFrame(rows, "document_id string, page_index bigint, idx bigint, source_text string").withColumn("page_count", F.lit(10))
    return classify.heading_cutoffs(df).select("document_id", F.col("cutoff").cast("int").alias("cutoff"))


@query("id, likely", "(1, true)", "(2, true)", "(3, true)", "(4, true)", "(5, false)")
def reference_likeness(spark, d):
    rows = [(1, "[1] A b\n2. C d"), (2, "1999 2001a 2003 doi: 10.1"), (3, "1990 1991 1992 1993 1994 Foo et al. x"), (4, "1801 1902 2003 2004 2005 2006 2007"), (5, "1801 1902 2003 2004 2005 2006")]
    return spark.createDataFrame(rows, "id int, t string").select("id", classify.reference_likeness("t")["likely"].alias("likely"))


@query("id, sentences", "(1, 'was found.[12]|The next')", "(2, 'was found.12,13|The next')", "(3, 'was found.[12] the next')", "(4, 'value 3.12 The')", "(5, 'Seen in a.[1]|B.[2]|Cells grew.')")
def citation_boundaries(spark, d):
    rows = [(1, "was found.[12] The next"), (2, "was found.12,13 The next"), (3, "was found.[12] the next"), (4, "value 3.12 The"), (5, "Seen in a.[1] B.[2] Cells grew.")]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.array_join(segment.split_sentences("t"), "|").alias("sentences"))


@query("id, sentences", "(1, 'see Fig. 3 shows.|End')", "(2, 'Smith, J. Doe!|No')", "(3, 'the casino. Next')", "(4, 'One!|Two?|Three…|Four')")
def abbreviation_merge(spark, d):
    rows = [(1, "see Fig. 3 shows. End"), (2, "Smith, J. Doe! No"), (3, "the casino. Next"), (4, "One! Two? Three… Four")]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.array_join(segment.split_sentences("t"), "|").alias("sentences"))


@query("id, space", "(1, false)", "(2, false)", "(3, false)", "(4, true)", "(5, false)")
def needs_space(spark, d):
    rows = [(1, "(", "a", False), (2, "a", ")", False), (3, "50", "%", False), (4, "a", "b", False), (5, "co-", "op", True)]
    return spark.createDataFrame(rows, "id int, a string, b string, n boolean").select("id", T.needs_space("a", "b", F.col("n")).alias("space"))


WORDS = [
    # document, page, pos, text, x0, y0, x1, y1, block, line
    ("d", 0, 0, "partici-", 10.0, 100.0, 60.0, 110.0, 0, 0),
    ("d", 0, 1, "pants", 10.0, 112.0, 40.0, 122.0, 0, 1),
    ("d", 0, 2, "(n", 42.0, 112.0, 52.0, 122.0, 0, 1),
    ("d", 0, 3, "=", 77.0, 112.0, 82.0, 122.0, 1, 0),
    ("d", 0, 4, "9)", 84.0, 112.0, 92.0, 122.0, 1, 0),
    ("d", 0, 5, "Next", 10.0, 140.0, 30.0, 150.0, 2, 0),
    ("d", 0, 6, "far", 55.1, 140.0, 70.0, 150.0, 3, 0),
]


def words(spark):
    return spark.createDataFrame(WORDS, "document_id string, page_index bigint, pos bigint, text string, x0 double, y0 double, x1 double, y1 double, block_no bigint, line_no bigint")


def placed(spark):
    return geometry.placed_words(words(spark), geometry.logical_blocks(words(spark)))


@query("block_no, logical_block_index", "(0, 0)", "(1, 0)", "(2, 1)", "(3, 2)")
def block_groups(spark, d):
    """A gap of 2.5 heights merges, one a little wider does not."""
    return geometry.logical_blocks(words(spark)).select(F.col("block_no").cast("int").alias("block_no"), F.col("logical_block_index").cast("int").alias("logical_block_index"))


@query("lb, text", "(0, 'partici-pants (n = 9)')", "(1, 'Next')", "(2, 'far')")
def block_text(spark, d):
    return geometry.block_text(placed(spark)).select(F.col("logical_block_index").cast("int").alias("lb"), "text")


def sentence_words(spark):
    spans = spark.createDataFrame([("d", 0, 0, 0, 0, 14), ("d", 0, 0, 1, 14, 99)], "document_id string, page_index bigint, logical_block_index bigint, sentence_index bigint, start bigint, `end` bigint")
    return geometry.word_sentence_overlap(placed(spark), spans)


@query("s, pos", "(0, 0)", "(0, 1)", "(1, 2)", "(1, 3)", "(1, 4)")
def word_sentence_overlap(spark, d):
    return sentence_words(spark).select(F.col("sentence_index").cast("int").alias("s"), F.col("pos").cast("int").alias("pos"))


@query("s, normalized", "(0, 'participants')", "(1, '(n = 9)')")
def dehyphenate(spark, d):
    return geometry.sentence_text(sentence_words(spark)).select(F.col("sentence_index").cast("int").alias("s"), F.col("normalized_text").alias("normalized"))


@query("s, box_index, x0, x1", "(0, 0, 10::DOUBLE, 60::DOUBLE)", "(0, 1, 10::DOUBLE, 40::DOUBLE)", "(1, 0, 42::DOUBLE, 52::DOUBLE)", "(1, 1, 77::DOUBLE, 92::DOUBLE)")
def line_boxes(spark, d):
    return geometry.line_boxes(sentence_words(spark)).select(F.col("sentence_index").cast("int").alias("s"), F.col("box_index").cast("int").alias("box_index"), "x0", "x1")


DRAWINGS = [("d", 4, 0, "line", 10.0, 400.0, 90.0, 401.0), ("d", 4, 1, "line", 10.0, 400.0, 40.0, 400.0), ("d", 4, 2, "line", 10.0, 400.0, 90.0, 402.0), ("d", 4, 3, "rect", 10.0, 500.0, 90.0, 503.0), ("d", 4, 4, "line", 0.0, 50.0, 100.0, 50.0), ("d", 1, 0, "line", 0.0, 300.0, 100.0, 300.0)]


def rules(spark):
    drawings = spark.createDataFrame(DRAWINGS, "document_id string, page_index bigint, seq bigint, kind string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", k, 100.0, 800.0) for k in range(5)], "document_id string, page_index bigint, width double, height double")
    return classify.rule_candidates(drawings, pages)


@query("page, seq, y", "(1, 0, 300::DOUBLE)", "(4, 0, 400.5::DOUBLE)", "(4, 3, 501.5::DOUBLE)")
def rule_candidates(spark, d):
    return rules(spark).select(F.col("page_index").cast("int").alias("page"), F.col("seq").cast("int").alias("seq"), "y")


@query("document_id, page, y", "('d', 4, 400.5::DOUBLE)")
def rule_cutoff(spark, d):
    rows = [("d", 4, 0, "[1]", 410.0, 0, 0), ("d", 4, 1, "Foo", 410.0, 0, 0), ("d", 4, 2, "[2]", 520.0, 0, 1), ("d", 4, 3, "Bar", 520.0, 0, 1), ("d", 1, 0, "[1]", 310.0, 0, 0), ("d", 1, 1, "x", 310.0, 0, 0), ("d", 1, 2, "[2]", 320.0, 0, 1), ("d", 1, 3, "y", 320.0, 0, 1)]
    w = spark.createDataFrame(rows, "document_id string, page_index bigint, pos bigint, text string, y0 double, block_no bigint, line_no bigint")
    counts = spark.createDataFrame([("d", 5)], "document_id string, page_count int")
    return classify.rule_cutoffs(rules(spark), w, counts).select("document_id", F.col("rule_page").cast("int").alias("page"), F.col("rule_y").alias("y"))


@query("idx, content_type, eligible", "(0, 'body', true)", "(1, 'end_matter', false)", "(2, 'end_matter', false)")
def classify_passages(spark, d):
    p = spark.createDataFrame([("d", k, 9, k, True, t) for k, t in enumerate(["Body text", "References Foo", "[1] Bar"])], "document_id string, page_index bigint, page_count int, idx bigint, retrieval_eligible boolean, source_text string").withColumn("page_index", F.col("page_index") + 5)
    got = classify.classify(p, classify.heading_cutoffs(p))
    return got.select(F.col("idx").cast("int").alias("idx"), "content_type", F.col("retrieval_eligible").alias("eligible"))


ANSWERS = [(1, '```json\n{"label": "direct_support", "evidence": [" s1 ", "S9", "s1"], "reason": " yes "}\n```'), (2, '{"label": "RELATED_ONLY", "evidence": "S1", "reason": ""}'), (3, '{"label": "REFERENCES", "evidence": []}'), (4, "no braces"), (5, '{"label": "NOT_MENTIONED"'), (6, '{"label": "NOT_MENTIONED", "evidence": []}'), (7, '{"label": "CONTRADICTS", bad}')]


@query("id, label, tags, ok", "(1, 'DIRECT_SUPPORT', 'S1,S9,S1', true)", "(2, 'RELATED_ONLY', '', true)", "(3, 'VERIFICATION_ERROR', '', false)", "(4, 'VERIFICATION_ERROR', '', false)", "(5, 'VERIFICATION_ERROR', '', false)", "(6, 'NOT_MENTIONED', '', true)", "(7, 'VERIFICATION_ERROR', '', false)")
def parse_verdict(spark, d):
    v = spark.createDataFrame(ANSWERS, "id int, raw string").withColumn("v", judge.parse_verdict("raw"))
    return v.select("id", "v.label", F.array_join("v.evidence_tags", ",").alias("tags"), F.col("v.parse_success").alias("ok"))


@query("id, plain, once, shown", "(1, 'a,b', 'a,b', 'a,b')", "(2, '', '', 'a,b')", "(3, 'b,b', 'b', 'b,b')")
def evidence_resolution(spark, d):
    """Known tags in order; repeated ones only if kept; without any the whole passage."""
    rows = [(1, ["S1", "S9", "S2"]), (2, []), (3, ["S2", "S2"])]
    ids, all_ = F.create_map(F.lit("S1"), F.lit("a"), F.lit("S2"), F.lit("b")), F.array(F.lit("a"), F.lit("b"))
    plain = judge.evidence(F.col("tags"), ids)
    return spark.createDataFrame(rows, "id int, tags array<string>").select("id", F.array_join(plain, ",").alias("plain"), F.array_join(judge.evidence(F.col("tags"), ids, True), ",").alias("once"), F.array_join(judge.evidence_or_all(plain, all_), ",").alias("shown"))


@query("passage_id, rank", "(2, 1)", "(1, 2)", "(3, 3)")
def rrf_order(spark, d):
    dense = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "claim_id bigint, passage_id int, dense_rank bigint")
    lex = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "claim_id bigint, passage_id int, bm25_rank bigint")
    return fusion.fuse(dense, lex).select("passage_id", F.col("fusion_rank").cast("int").alias("rank"))


@query("policy, source_path, status", *[f"('{p}', '{s}', '{r}')" for p, r in (("ask", "failed"), ("discard", "discarded"), ("replace", "replaced")) for s, r in (("a", "added"), ("b", r), ("c", r), ("d", "failed"))])
def duplicate_policy(spark, d):
    batch = spark.createDataFrame([("a", "h1", None), ("b", "h1", None), ("c", "h0", None), ("d", "h9", "ValueError")], "source_path string, sha256 string, error_type string")
    known = spark.createDataFrame([("h0",)], "sha256 string")
    out = None
    for p in ingest.POLICIES:
        part = ingest.outcomes(batch, known, p).select(F.lit(p).alias("policy"), "source_path", "status")
        out = part if out is None else out.union(part)
    return out


CORPORA = [("/a", "2024-01-01T00:00:00+00:00", True), ("/b", "2024-01-11T00:00:00+00:00", True), ("/c", "2024-01-11T00:00:01+00:00", True), ("/d", "soon", True), ("/e", None, True), ("/f", None, False)]


def inactive(spark):
    c = spark.createDataFrame(CORPORA, "root string, last_accessed_at string, valid boolean")
    return report.inactive(c, 20, F.to_timestamp(F.lit("2024-01-31T00:00:00+00:00")))


@query("root, status", "('/a', 'ready')", "('/b', 'ready')", "('/d', 'untracked')", "('/e', 'untracked')", "('/f', 'invalid')")
def inactive_corpora(spark, d):
    """Unused for exactly that many days counts."""
    return inactive(spark).select("root", "status")


@query("root, preview, applied", "('/a', 'preview', 'ready')", "('/b', 'preview', 'ready')", "('/d', 'untracked', 'untracked')", "('/e', 'untracked', 'untracked')", "('/f', 'invalid', 'invalid')")
def cleanup_preview(spark, d):
    """One invalid target keeps all others from being deleted."""
    one = report.cleanup_outcomes(inactive(spark), False).select("root", F.col("outcome").alias("preview"))
    return one.join(report.cleanup_outcomes(inactive(spark), True).select("root", F.col("outcome").alias("applied")), "root")


# --- whole ingestions of inline documents

ONE = "The red fox crossed the frozen river at night. It was seen by two of the hunters there."
TWO = "Second document has one page only here.\fAnd a second page with quite a few more words in it."


def _sources(spark, *rows):
    return readers.from_texts(spark.createDataFrame(list(rows), "id string, text string"), "id", "text")


def _corpus(spark) -> Corpus:
    return Corpus.create(spark, f"{scratch.folder(spark)}/corpus-{uuid.uuid4().hex}")


#: Corpora that several queries look at, made once in an application.
_made: dict[tuple, tuple] = {}


def _once(spark, name: str, make):
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _repeats(spark, policy: str) -> tuple:
    """A batch that holds one content twice, then a batch with a known content and a new one; and all outcomes."""

    def make():
        c = _corpus(spark)
        first = c.ingest(_sources(spark, ("a", ONE), ("b", ONE)), policy)
        return c, first.unionByName(c.ingest(_sources(spark, ("c", TWO), ("d", ONE)), policy))

    return _once(spark, policy, make)


@query("policy, filename, page_count, pages, sentences, passages, words", *[f"('{p}', '{one}', 1, 1, 2, 1, 18)" for p, one in (("ask", "a.txt"), ("discard", "a.txt"), ("replace", "d.txt"))], *[f"('{p}', 'c.txt', 2, 2, 2, 2, 19)" for p in ("ask", "discard", "replace")])
def ingest_tables(spark, d):
    """What is left of repeated contents under each policy: one document with each page, sentence and passage once."""
    out = None
    for policy in ingest.POLICIES:
        c, _ = _repeats(spark, policy)
        n = lambda name: c.table(name).groupBy("document_id").agg(F.count(F.lit(1)).alias(name))  # noqa: B023, E731
        words = c.table("passages").groupBy("document_id").agg(F.sum("word_count").alias("words"))
        part = c.table("documents").select("document_id", "filename", "page_count")
        for x in (n("pages"), n("sentences"), n("passages"), words):
            part = part.join(x, "document_id")
        part = part.select(F.lit(policy).alias("policy"), "filename", "page_count", *[F.col(x).cast("int").alias(x) for x in ("pages", "sentences", "passages")], F.col("words").cast("int").alias("words"))
        out = part if out is None else out.union(part)
    return out


@query("policy, source_path, status", *[f"('{p}', 'table/{s}.txt', '{r}')" for p, t in (("ask", "failed"), ("discard", "discarded"), ("replace", "replaced")) for s, r in (("a", "added"), ("b", t), ("c", "added"), ("d", t))])
def ingest_outcomes(spark, d):
    out = None
    for policy in ingest.POLICIES:
        part = _repeats(spark, policy)[1].select(F.lit(policy).alias("policy"), "source_path", "status")
        out = part if out is None else out.union(part)
    return out


def _line(text: str, y: float, block: int, line: int = 0, x: float = 10.0) -> list[tuple]:
    """Words of a line, six points a character."""
    out = []
    for w in text.split(" "):
        out.append((w, x, y, x + 6.0 * len(w), y + 10.0, block, line))
        x += 6.0 * (len(w) + 1)
    return out


def paged_document() -> str:
    """Three pages with words and a rule, below which stands a bibliography without a heading; one page has no words."""
    first = _line("We saw many partici-", 100, 0, 0) + _line("pants in this study of the river. They came", 112, 0, 1) + _line("back [3].", 112, 1, 0, 290.0) + _line("A far block.", 300, 2)
    last = _line("The last words of the body stand above the rule here.", 200, 0) + _line("[1] First A. and B. of the year 2001 in a journal.", 520, 1, 0) + _line("[2] Second C. and D. of the year 2002 in a book.", 540, 1, 1)
    pages = [{"words": first}, {"words": []}, {"words": last, "drawings": [("line", 10.0, 500.0, 500.0, 500.5)]}]
    pages = [p | {"text": " ".join(w[0] for w in p["words"]), "width": 600.0, "height": 800.0} for p in pages]
    return json.dumps({"metadata": {"title": " On rivers ", "author": "A. Writer", "subject": ""}, "pages": pages})


def paged(spark) -> Corpus:
    def make():
        c = _corpus(spark)
        return c, c.ingest(_sources(spark, ("p", paged_document())), make_decoder=readers.JsonDecoder)

    return _once(spark, "paged", make)[0]


@query("page, block, place, source, normalized, words", "(0, 0, 0, 'We saw many partici-pants in this study of the river.', 'We saw many participants in this study of the river.', 11)", "(0, 0, 1, 'They came back [3].', 'They came back [3].', 4)", "(0, 1, 0, 'A far block.', 'A far block.', 3)", "(2, 0, 0, 'The last words of the body stand above the rule here.', 'The last words of the body stand above the rule here.', 11)", "(2, 1, 0, '[1] First A. and B. of the year 2001 in a journal.', '[1] First A. and B. of the year 2001 in a journal.', 12)", "(2, 1, 1, '[2] Second C. and D. of the year 2002 in a book.', '[2] Second C. and D. of the year 2002 in a book.', 12)")
def page_sentences(spark, d):
    """From words with geometry to sentences: blocks on one visual line are joined, hyphens at line ends are resolved."""
    c = lambda x, y: F.col(x).cast("int").alias(y)
    return paged(spark).table("sentences").select(c("page_index", "page"), c("logical_block_index", "block"), c("block_sentence_index", "place"), F.col("source_text").alias("source"), F.col("normalized_text").alias("normalized"), c("source_word_count", "words"))


@query("sentence, box, block, line, x0, y0, y1", "(0, 0, 0, 0, 10.0::DOUBLE, 100.0::DOUBLE, 110.0::DOUBLE)", "(0, 1, 0, 1, 10.0::DOUBLE, 112.0::DOUBLE, 122.0::DOUBLE)", "(1, 0, 0, 1, 214.0::DOUBLE, 112.0::DOUBLE, 122.0::DOUBLE)", "(1, 1, 1, 0, 290.0::DOUBLE, 112.0::DOUBLE, 122.0::DOUBLE)", "(2, 0, 2, 0, 10.0::DOUBLE, 300.0::DOUBLE, 310.0::DOUBLE)")
def page_boxes(spark, d):
    """The boxes of the first page's sentences, one for each block and line."""
    c = paged(spark)
    b = c.table("sentence_boxes").join(c.table("sentences").filter("page_index = 0").select("display_id", "page_sentence_index"), "display_id")
    i = lambda x, y: F.col(x).cast("int").alias(y)
    return b.select(i("page_sentence_index", "sentence"), i("box_index", "box"), i("block_no", "block"), i("line_no", "line"), "x0", "y0", "y1")


@query("page, block, content_type, eligible, blocks", "(0, 0, 'body', true, '0,1')", "(0, 1, 'body', false, '2')", "(2, 0, 'body', true, '0')", "(2, 1, 'end_matter', false, '1')")
def page_classes(spark, d):
    """Without a heading the rule cuts: the passage below it is end matter. blocks: the physical ones under a passage."""
    c = paged(spark)
    blocks = report.block_numbers(c.table("sentence_boxes"), c.table("passage_sentences"))
    p = c.table("passages").join(blocks, F.col("display_id") == F.col("passage"))
    return p.select(F.col("page_index").cast("int").alias("page"), F.col("logical_block_index").cast("int").alias("block"), "content_type", F.col("retrieval_eligible").alias("eligible"), F.array_join(F.transform("block_nos", lambda x: x.cast("string")), ",").alias("blocks"))


@query("title, authors, abstract, page_count, types", "('On rivers', 'A. Writer', NULL, 3, 'body,end_matter')")
def page_metadata(spark, d):
    """Embedded metadata, trimmed; empty text is none."""
    c = paged(spark)
    types = report.content_types(c.table("passages"))
    return c.table("documents").crossJoin(types).select("title", F.array_join("authors", ",").alias("authors"), "abstract", "page_count", F.array_join("content_types", ",").alias("types"))  # one row each


@query("page, passage, top_y", "(0, 0, 100.0::DOUBLE)", "(0, 1, 300.0::DOUBLE)", "(2, 0, 200.0::DOUBLE)", "(2, 1, 520.0::DOUBLE)")
def passage_tops(spark, d):
    c = paged(spark)
    tops = geometry.top_edges(c.table("sentence_boxes"), c.table("passage_sentences"))
    p = c.table("passages").join(tops, F.col("display_id") == F.col("passage"))
    return p.select(F.col("page_index").cast("int").alias("page"), F.col("logical_block_index").cast("int").alias("passage"), "top_y")


@query("display_id, page_number, name, boxes, status", "(1, 1, 'On rivers', 2, 'sparse')", "(2, 1, 'On rivers', 2, 'sparse')", "(3, 1, 'On rivers', 1, 'sparse')", "(4, 3, 'On rivers', 1, 'ok')", "(5, 3, 'On rivers', 1, 'ok')", "(6, 3, 'On rivers', 1, 'ok')")
def sentence_details(spark, d):
    """Sentences (numbered here by document) with page, document and boxes."""
    c = paged(spark)
    got = review.details(c.table("sentences"), c.table("sentence_boxes"), c.table("pages"), c.table("documents"))
    return got.select((F.col("document_sentence_index") + 1).cast("int").alias("display_id"), F.col("page_number").cast("int").alias("page_number"), "name", F.size("boxes").alias("boxes"), F.col("extraction_status").alias("status"))


@query("id, html", "('x', '<!doctype html><meta charset=\"utf-8\"><h1>x</h1>\n<section><h2>Page 1: sparse</h2><pre>a &lt;b&gt; &amp; &quot;c&quot;</pre></section>\n<section><h2>Page 2: empty</h2><pre></pre></section>')")
def extraction_review(spark, d):
    pages = spark.createDataFrame([("x", 1, 2, "empty", ""), ("x", 0, 1, "sparse", 'a <b> & "c"')], "document_id string, page_index bigint, page_number bigint, extraction_status string, extracted_text string")
    return review.extraction_review(pages).select(F.col("document_id").alias("id"), "html")


@query("id, size", "(1, '1023 B')", "(2, '1.5 KiB')", "(3, '2.0 MiB')", "(4, '3.0 GiB')")
def human_sizes(spark, d):
    rows = [(1, 1023), (2, 1536), (3, 2 << 20), (4, 3 << 30)]
    return spark.createDataFrame(rows, "id int, n bigint").select("id", T.human_size("n").alias("size"))


@query("id, name", "('a', 'Title')", "('b', 'b.pdf')", "('c', 'c')")
def display_names(spark, d):
    """Title, else file name, else id; also where the document isn't there."""
    docs = spark.createDataFrame([("a", "Title", "a.pdf"), ("b", "", "b.pdf")], "document_id string, title string, filename string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    return review.with_names(rows, docs).select(F.col("document_id").alias("id"), "name")


@query("id, text", "(1, 'a')", "(2, 'b')", "(3, '')")
def first_filled(spark, d):
    """The first value that is neither null nor empty, trimmed."""
    rows = [(1, " a ", "b"), (2, "", "b "), (3, None, "")]
    return spark.createDataFrame(rows, "id int, a string, b string").select("id", T.falsy("a", "b").alias("text"))


@query("child, parent", "(1, 'a')", "(3, 'b')")
def cascade_delete(spark, d):
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, "b"), (4, "x")], "child int, parent string")
    return report.cascade_delete(child, spark.createDataFrame([("x",)], "parent string"), "parent")
